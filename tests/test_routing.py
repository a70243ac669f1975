"""Routing queries see what encoded commands hold, and the decoder's substitutions."""

import base64

from pyspark.sql import functions as F

from cmdlake.functions import decoding
from cmdlake.plans import command_queries


def encoded(text, encoding="utf-8"):
    return base64.b64encode(text.encode(encoding)).decode()


HIDDEN = {
    1: (encoded("nmap -sS host1"), "has_offensive_tooling"),
    2: (encoded(encoded("mkfs.ext4 /dev/sda1 now")), "has_destructive_write"),
    3: ("powershell -enc " + encoded("cat /etc/shadow | less", "utf-16-le"), "has_credential_dumping_pattern"),
    4: ('"' + '" + "'.join("mimikatz") + '" + [char]10', "has_credential_dumping_pattern"),
    5: ("[char]109 + imikatz", "has_credential_dumping_pattern"),
    6: ("(109..110)+imikatz | % {[char]$_}", "has_credential_dumping_pattern"),
    7: ("ls -la", None),
}


def test_features_of_decoded_views(spark, monkeypatch):
    df = spark.createDataFrame([(k, v[0], 20.0) for k, v in HIDDEN.items()], "event_id long, command string, value double")
    monkeypatch.setattr(command_queries, "commands", lambda *_: df)
    got = {r.event_id: r for r in command_queries.rte1_routing_features(spark, "").collect()}
    for k, (_, feature) in HIDDEN.items():
        assert feature is None or got[k][feature], k
    benign = df.withColumn("value", F.lit(90.0))
    monkeypatch.setattr(command_queries, "commands", lambda *_: benign)
    label = {r.event_id: r.label for r in command_queries.rte2_rte5_route(spark, "").collect()}
    assert label == {k: "Suspicious" if v[1] else "Benign" for k, v in HIDDEN.items()}


def test_substitutions():
    assert decoding.characters("(65..70)+bc | % {[char]$_}") == '"Abc"'
    assert decoding.characters("(97 .. 60) + _x | %{ [CHAR] $_ }") == '"' + "".join(map(chr, range(97, 59, -1))).replace("\\", "\\\\") + '_x"'
    assert decoding.characters("(65..67) | % {[char]$_}") == '"ABC"'
    assert decoding.concatenated('"a" + "b" + cd e') == '"abcd" e'
    assert decoding.trace('[char]65 + bc')[0] == '"Abc"'
