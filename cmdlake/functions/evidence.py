"""Evidence: indicators of every view of a command as records, and a summary struct of each command."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlake.functions.parsing import all_of, valid_ips

# Fixed values.
FLAGS = [
    "-enc", "-encodedcommand", "-e", "-c", "/c", "-nop", "-noni", "-noninteractive", "-windowstyle", "-w", "-exec", "-executionpolicy", "-ep", "-bypass", "-command", "/create", "/sc", "/tr", "/tn", "/f", "/d", "/t", "/v", "/s",
    "/add", "/delete", "-split", "-f", "-o", "--output", "-urlcache", "-decode", "-encode", "-decodefile", "-p", "--post-file", "-b64", "--allow-overwrite", "--on-download-complete", "-perm", "+4000", "+2000", "-rf", "--flush",
    "/set", "/get", "/query", "/export", "/import",
]
IPV6 = r"(?<![\w:])\[?[0-9A-Fa-f:]{3,}\]?(?![\w:])"
HASH, DEFANGED, URL = r"(?<![A-Fa-f0-9])(?:[A-Fa-f0-9]{64}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{32})(?![A-Fa-f0-9])", r"(?i)\bhxxps?://[^\s\x22\x27<>|]+", r"(?i)\b(?:https?|ftp)://[^\s\x22\x27<>|]+"
SECTIONS = ("urls", "domains", "ips", "ipv6", "ports", "file_paths", "registry_paths", "hashes", "defanged_urls")
MERGED = ("file_paths", "registry_paths", "urls", "domains", "ips", "ports", "lolbin_matches", "local_targets", "remote_targets", "flags", "encoded_markers", "obfuscation_markers")
EITHER = ("has_pipe", "has_redirect", "has_chain", "inline_code")


def _canonical(found: pd.Series) -> pd.Series:
    def address(text: str) -> str | None:
        try:
            return str(ipaddress.IPv6Address(text.strip("[]")))
        except ValueError:
            return None

    return found.map(lambda items: [] if items is None else list(dict.fromkeys(a for x in items if (a := address(x)))))


def ipv6(text: Column) -> Column:
    """Canonical IPv6 addresses; only texts with a candidate reach Python."""
    some = F.filter(all_of(text, IPV6), lambda x: F.contains(x, F.lit(":")))
    return F.when(F.size(some) > 0, F.pandas_udf(_canonical, "array<string>")(F.when(F.size(some) > 0, some))).otherwise(F.array().cast("array<string>"))


def refanged(text: Column) -> Column:
    plain = lambda u: F.replace(F.replace(F.regexp_replace(F.regexp_replace(u, r"[;,.!)]+$", ""), r"(?i)\[\.\]", "."), F.lit("hxxps"), F.lit("https")), F.lit("hxxp"), F.lit("http"))
    return F.array_distinct(F.transform(all_of(text, DEFANGED), plain))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def found_in(text: Column) -> Column:
    """Indicators of a text that wasn't parsed, as array<struct(type, value)>; a URL's host counts as domain or address."""
    urls = F.array_distinct(all_of(text, URL))
    hosts = F.array_distinct(F.filter(F.transform(urls, host_of), lambda h: h != ""))
    is_ip = lambda h: F.size(valid_ips(h)) > 0
    typed = lambda items, kind: F.transform(items, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    return F.concat(
        typed(urls, "url"), typed(F.filter(hosts, lambda h: ~is_ip(h)), "domain"), typed(F.filter(hosts, is_ip), "ip"),
        typed(F.array_distinct(F.transform(all_of(text, HASH), F.lower)), "hash"), typed(ipv6(text), "ip"), typed(refanged(text), "defanged_url"),
    )


def views(df: DataFrame, key: str, command: str = "command", name: str = "decode") -> DataFrame:
    """key, source_view, text, decoder: the raw text, each layer that isn't the final text, and the final text if it differs."""
    raw, final, steps = F.col(command), F.col(f"{name}.final"), F.col(f"{name}.steps")
    view = lambda n, t, d: F.struct(n.alias("source_view"), t.alias("text"), d.cast("string").alias("decoder"))
    layers = F.filter(F.transform(steps, lambda s, i: view(F.concat(F.lit("layer_"), (i + 1).cast("string")), s["text"], s["transform"])), lambda v: v["text"] != final)
    last = F.when(final != raw, F.array(view(F.lit("decoded"), final, F.try_element_at(steps, F.lit(-1))["transform"]))).otherwise(F.slice(F.array(view(F.lit(""), raw, F.lit(None))), 1, 0))
    return df.select(key, F.explode(F.concat(F.array(view(F.lit("raw"), raw, F.lit(None))), layers, last)).alias("v")).select(key, "v.*")


def indicator_records(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row per (key, view, type, value): where the value first stands, its decoder, and whether it was observed or derived."""
    keep = [c for c in (key, "source_view", "decoder") if c in df.columns]
    each = df.select(*keep, text, F.explode(F.array_distinct(found_in(F.col(text)))).alias("i"))
    at = F.expr(f"locate(lower(i.value), lower(`{text}`))")
    return each.select(
        *keep, "i.type", "i.value", F.when(at > 0, at - 1).alias("span_start"), F.when(at > 0, at - 1 + F.length("i.value")).alias("span_end"), F.when(at > 0, "observed").otherwise("derived").alias("confidence")
    )


def merged_views(raw: DataFrame, decoded: DataFrame, key: str) -> DataFrame:
    """One row a key of two parses: lists joined in order without repeats, flags of either."""
    both = raw.join(decoded.select(key, *[F.col(c).alias(f"other_{c}") for c in (*MERGED, *EITHER)]), key, "left")
    both = both.withColumns({c: F.when(F.col(f"other_{c}").isNull(), F.col(c)).otherwise(F.array_distinct(F.concat(c, f"other_{c}"))) for c in MERGED} | {c: F.col(c) | F.coalesce(F.col(f"other_{c}"), F.lit(False)) for c in EITHER})
    return both.drop(*[f"other_{c}" for c in (*MERGED, *EITHER)])


def artefact() -> Column:
    """What a command touches first: registry, task, service, archive, network, script or file."""
    some = lambda *names: F.expr(" OR ".join(f"size({n}) > 0" for n in names))
    return (
        F.when(some("registry_paths"), "registry").when(F.col("creates_scheduled_task"), "task").when(F.col("creates_or_modifies_service"), "service").when(F.expr("archive_create OR archive_extract"), "archive")
        .when(some("urls", "remote_targets") | F.col("downloads_remote_resource"), "network").when(F.expr("runs_interpreter OR executes_inline_code"), "script").when(some("file_paths"), "file")
    )


def style() -> Column:
    fetch = F.col("downloads_remote_resource")
    return (
        F.when(fetch & F.expr("executes_inline_code OR has_pipe"), "download-and-execute").when(F.col("creates_scheduled_task"), "scheduled").when(F.col("remote_execution_or_session"), "remote-session")
        .when(F.expr("executes_inline_code OR inline_code"), "inline").when(fetch, "download-and-execute")
    )


def high_signal_flags() -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform("flags", F.lower), lambda f: f.isin(*FLAGS))))


def project_results(df: DataFrame, sections: list[str], iocs: str | list[str] = "all", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, the asked sections, and of `iocs` all or the named indicator columns; unknown names are errors."""
    wanted = [c for c in SECTIONS if c in df.columns] if iocs == "all" else list(iocs)
    unknown = [s for s in sections if s not in (*df.columns, "iocs")] + [i for i in wanted if i not in SECTIONS]
    if unknown:
        raise ValueError(f"unknown sections or indicators: {', '.join(unknown)}")
    return df.select(*keys, *[F.struct(*wanted).alias("iocs") if s == "iocs" else F.col(s) for s in sections])
