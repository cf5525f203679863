"""Queries that SQL can't express, and contracts that refuse a file, against plain Python on small tables."""

import difflib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.catalog import QUERIES, labels
from tidewell.plans import releases
from tidewell.sources import files, publish

DATA = "/root/testdata/sf0.001"


def test_fuzzy_pairs_are_all_pairs_at_the_ratio(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet").select("p_brand", "p_size", "p_name").distinct().collect()
    groups = defaultdict(list)
    for brand, size, name in parts:
        groups[brand, size].append(name)
    want = Counter()
    for key, names in groups.items():
        for a in names:
            for b in names:
                if a < b:
                    ratio = 0.92 if a in b else difflib.SequenceMatcher(None, a, b).ratio()
                    if ratio >= 0.32:
                        want[(*key, a, b, round(ratio, 9))] += 1
    got = QUERIES["fuzzy_pairs"](spark, DATA).select("p_brand", "p_size", "p_name", "other", F.round("ratio", 9)).collect()
    assert Counter(map(tuple, got)) == want and want




def test_contracts_refuse(spark, tmp_path):
    def written(rows, columns):
        path = f"file://{tmp_path}/{len(list(tmp_path.iterdir()))}"
        publish.write_csv(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)), path, columns)
        return path

    read = lambda path: files.contract_csv(spark, path, labels.CONTRACTS, "is_broker", {"legacy", "staging"})
    for rows, columns in (
        ([("a", "b")], ["broker", "project"]), ([("b", "p", "true", "c")], ["project", "broker", "is_broker", "category"]),
        ([("b", "p", "maybe", "c")], labels.CURRENT), ([(" ", "", "", " ")], labels.CURRENT),
    ):
        with pytest.raises(files.InputError):
            read(written(rows, columns)).collect()
    for cell in ("not json", '{"a": 1}', '["a"'):
        with pytest.raises(files.InputError):
            files.typed_csv(spark, written([("x", cell)], ["a", "b"]), ["a", "b"], ["b"])
    with pytest.raises(files.InputError):
        files.typed_csv(spark, written([("[]", "x")], ["b", "a"]), ["a", "b"], ["b"], strict=True)
    assert files.typed_csv(spark, written([("[]", "x")], ["b", "a"]), ["a", "b", "c"], ["b"]).collect()[0] == ("x", [], "")
