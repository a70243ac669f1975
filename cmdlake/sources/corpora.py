"""Readers of command corpora: tables, manifests, line and page files, YAML catalogues, STIX bundles, run metadata.

Files are read by Spark's own readers; only YAML documents, which Spark doesn't know, pass through Python, one file a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlake.functions.parsing import all_of
from cmdlake.functions.text import strip
from cmdlake.operators.curation import cleaned_command, script_line
from cmdlake.sources.commands import history_command

# Fixed values.
KINDS = ("jsonl", "history", "text")
MOST_WORDS = 60


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, or JSON lines, by the path's suffix; blank lines are skipped."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if path.rstrip("/").endswith((".jsonl", ".json")):
        return spark.read.schema(schema).json(path)
    raise ValueError(f"neither CSV nor JSON lines: {path}")


def load_sources(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """command, label, source_type, source_name of all sources; a row's own fields win over its source's defaults."""
    tables = []
    for source in manifest:
        if source["kind"] not in KINDS:
            raise ValueError(f"no such kind of source: {source['kind']}")
        given = lambda name: F.lit(source.get(name))  # noqa: B023, E731
        if source["kind"] == "jsonl":
            rows = spark.read.schema("command string, label string, source_type string").json(source["path"])
        else:
            line = F.col("value") if source["kind"] == "text" else history_command(F.col("value"))
            rows = spark.read.text(source["path"]).select(line.alias("command"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("source_type"))
        own = lambda c: F.when(strip(F.col(c)) != "", strip(F.col(c)))
        tables.append(rows.select(own("command").alias("command"), *[F.coalesce(own(c), given(c).cast("string")).alias(c) for c in ("label", "source_type")], given("name").cast("string").alias("source_name")).filter("command is not null"))
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def line_corpus(spark: SparkSession, path: str) -> DataFrame:
    """command: the lines of text files that are commands."""
    return spark.read.text(path).select(cleaned_command(F.col("value")).alias("command")).filter("command is not null")


def page_command(line: Column) -> Column:
    """The command of a page's line that is one back-ticked span; else null."""
    found = F.regexp_extract(line, r"^`([^`]+)`\s*$", 1)
    return F.when(found != "", cleaned_command(found))


def page_corpus(spark: SparkSession, path: str) -> DataFrame:
    """command, page: examples of the English pages below a folder (pages/, not pages.<language>/)."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path).withColumn("page", F.input_file_name())
    return lines.filter(F.col("page").rlike(r"/pages/")).select(page_command(F.col("value")).alias("command"), "page").filter("command is not null")


def yaml_documents(spark: SparkSession, path: str, paths: dict[str, list[str]], pattern: str = "*.y*ml") -> DataFrame:
    """path, field, name, value: for each field the strings at a path of keys; `*` goes through a list or a mapping, whose key is the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("content").cast("string").alias("text"))

    def walk(node, steps: list[str], name: str | None) -> Iterator[tuple[str | None, str]]:
        if not steps:
            if node is not None and not isinstance(node, (dict, list)):
                yield name, str(node)
        elif steps[0] == "*":
            items = node.items() if isinstance(node, dict) else ((name, x) for x in node) if isinstance(node, list) else ()
            for key, x in items:
                yield from walk(x, steps[1:], key)
        elif isinstance(node, dict):
            yield from walk(node.get(steps[0]), steps[1:], name)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            out = []
            for place, text in zip(frame["path"], frame["text"]):
                try:
                    documents = list(yaml.safe_load_all(text))
                except yaml.YAMLError:
                    continue  # as a file that is no YAML has no commands
                out += [(place, field, name, value) for d in documents for field, steps in paths.items() for name, value in walk(d, steps, None)]
            yield pd.DataFrame(out, columns=["path", "field", "name", "value"])

    return files.mapInPandas(read, "path string, field string, name string, value string")


def attack_tests(spark: SparkSession, path: str) -> DataFrame:
    """command, technique: lines of the tests' commands; the technique is the file's name."""
    found = yaml_documents(spark, path, {"command": ["atomic_tests", "*", "executor", "command"]})
    lines = found.select(F.regexp_extract("path", r"(T\d{4})(?:\.\d{3})?", 1).alias("technique"), F.explode(F.split("value", r"\r?\n")).alias("line"))
    return lines.select(cleaned_command(script_line(F.col("line"))).alias("command"), "technique").filter("command is not null and technique <> ''")


def binary_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """command, technique of catalogues that list Commands with a MitreID each; only parent techniques."""
    files = yaml_documents(spark, path, {"command": ["Commands", "*", "Command"], "id": ["Commands", "*", "MitreID"]})
    # both lists of a file come in one order, so that they pair by place; files hold a few commands each
    lists = files.groupBy("path").agg(*[F.collect_list(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("command", "id")])
    pairs = lists.filter(F.size("command") == F.size("id")).select(F.explode(F.arrays_zip("command", "id")).alias("p"))
    technique = F.regexp_extract(F.trim("p.id"), r"^(T\d{4})", 1)
    return pairs.select(cleaned_command(F.col("p.command")).alias("command"), technique.alias("technique")).filter(F.col("command").isNotNull() & F.col("technique").rlike(r"^T\d{4}$"))


def function_catalogue(spark: SparkSession, path: str, techniques: dict[str, str]) -> DataFrame:
    """command, technique of catalogues of functions with code; functions outside the map go."""
    found = yaml_documents(spark, path, {"code": ["functions", "*", "*", "code"]}, "*")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in techniques.items() for x in kv]), F.col("name"))
    lines = found.select(known.alias("technique"), F.explode(F.split("value", r"\r?\n")).alias("line")).filter("technique is not null")
    return lines.select(cleaned_command(script_line(F.col("line"))).alias("command"), "technique").filter("command is not null")


def snippets(text: Column) -> Column:
    """Commands in a description: <code> elements and back-ticked spans with at most 60 words and the look of a command."""
    found = F.concat(all_of(text, r"(?s)<code>(.*?)</code>", 1), all_of(text, r"`([^`\n]+)`", 1))
    clean = F.transform(found, cleaned_command)
    return F.array_distinct(F.filter(clean, lambda c: c.isNotNull() & (F.size(F.split(c, " ")) <= MOST_WORDS) & (c.contains(" ") | c.rlike(r"[/\\.]"))))


def stix_commands(spark: SparkSession, path: str) -> DataFrame:
    """command, technique: snippets of attack patterns and of the relationships that use them (an equi-join on the pattern's id)."""
    refs = "array<struct<source_name: string, external_id: string>>"
    objects = spark.read.option("multiLine", True).schema(f"objects array<struct<type: string, id: string, description: string, relationship_type: string, target_ref: string, external_references: {refs}>>").json(path)
    o = objects.select(F.explode("objects").alias("o")).select("o.*")
    external = F.filter("external_references", lambda r: r["external_id"].rlike(r"^T\d{4}"))[0]["external_id"]
    patterns = o.filter("type = 'attack-pattern'").select("id", "description", F.regexp_extract(external, r"^(T\d{4})", 1).alias("technique")).filter("technique <> ''")
    uses = o.filter("type = 'relationship' and relationship_type = 'uses'").select("description", F.col("target_ref").alias("id")).join(patterns.select("id", "technique"), "id")
    return patterns.select("description", "technique").unionByName(uses.select("description", "technique")).select(F.explode(snippets(F.col("description"))).alias("command"), "technique").distinct()


def technique_families(patterns: DataFrame, families: dict[str, str]) -> DataFrame:
    """technique, families (sorted) of rows with technique, phases and deprecated; phases outside the map go."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in families.items() for x in kv]), F.col("phase"))
    each = patterns.filter(~F.coalesce("deprecated", F.lit(False))).select("technique", F.explode("phases").alias("phase")).select("technique", named.alias("family"))
    return each.filter("family is not null").groupBy("technique").agg(F.array_sort(F.collect_set("family")).alias("families"))


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, metadata of each valid JSON object below a folder: evaluation, training or other by its keys."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")
    m = F.from_json("value", "map<string, string>")
    kind = F.when(F.array_contains(F.map_keys(m), "metrics"), "evaluation").when(F.array_contains(F.map_keys(m), "training_manifest"), "training").otherwise("other")
    return files.filter(F.try_parse_json("value").isNotNull()).select("path", kind.alias("kind"), m.alias("metadata")).filter(F.col("metadata").isNotNull())
