"""What one task holds stays as the tables grow."""

import random

from pyspark.sql import functions as F

from fleetsight.operators import reference
from fleetsight.operators import security as S
from fleetsight.plans import strategies
from fleetsight.session import cut_lineage
from fleetsight.sources.trigrams import TrigramIndex


def _permission_lists(rows):
    groups = {}
    for who, obj, state, permission, column in set(rows):
        groups.setdefault((who, obj, state), {}).setdefault(permission, set()).add(column)
    out = set()
    for key, held in groups.items():
        items = []
        for p in sorted(p for p in held if p is not None):
            cols = ", ".join(sorted(c for c in held[p] if c is not None))
            items.append(f"{p} ({cols})" if cols else p)
        out.add((*key, ", ".join(items) if items else None))
    return out


def test_permissions_are_aggregated_in_partitions_of_a_fixed_size(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice([1, 2, None]), r.choice(["a", "b", None]), r.choice(["GRANT", "DENY", None]),
             r.choice(["SELECT", "INSERT", None]), r.choice([None, "", "x", "y"])) for _ in range(120)]
    grants = spark.createDataFrame(rows, "grantee_id int, object_name string, state string, permission string, "
                                         "column_name string")
    got = [tuple(x) for x in S.principal_permissions(grants).collect()]
    assert len(got) == len(set(got)) and set(got) == _permission_lists(rows)
    for size, parts in ((1 << 20, 8), (200 << 20, 25), (1 << 31, 256)):
        monkeypatch.setattr(strategies, "input_bytes", lambda df, size=size: size)
        assert S.principal_permissions(grants).rdd.getNumPartitions() == parts


def test_input_bytes_are_of_the_files_also_behind_joins(spark, tmpdir_path):
    spark.range(1000).write.parquet(tmpdir_path + "/t")
    t = spark.read.parquet(tmpdir_path + "/t")
    one = strategies.input_bytes(t)
    assert 0 < strategies.input_bytes(t.join(t.select(F.col("id").alias("id2")), F.col("id") < F.col("id2"))) <= 2 * one
    assert strategies.input_bytes(cut_lineage(t)) is None


def test_nodes_that_many_starts_reach_give_the_same_closure(spark, monkeypatch):
    r = random.Random(5)
    edges = [("A", f"a{k}", f"a{r.randrange(k)}" if k and k % 4 else None, "B", r.choice(["b0", "b1", "b2", None]))
             for k in range(30)]
    edges += [("B", "b0", None, None, None), ("B", "b1", "b0", "C", "c"), ("B", "b2", "b1", "C", "c"), (None, "a1", "a0", "B", "b1")]
    starts = [("A", f"a{k}") for k in range(30)] + [("A", "a3"), ("A", None), (None, "a1")]
    e = spark.createDataFrame(edges, "class_desc string, permission_name string, covering_permission_name string, "
                                     "parent_class_desc string, parent_covering_permission_name string")
    s = spark.createDataFrame(starts, "class_desc string, permission_name string")
    steps = {}
    for c, p, inside, up_class, up in edges:
        for step in ([(c, inside, 0)] if inside else []) + ([(up_class, up, 1)] if up else []):
            steps.setdefault((c, p), set()).add(step)
    want, front, depth = {}, {(x, x, 0) for x in starts}, 0
    while front:
        want.update({(*a, *b, level): depth for a, b, level in front})
        front = {(a, (c, p), level + up) for a, b, level in front if None not in b for c, p, up in steps.get(b, ())}
        depth += 1
    for hot, few in ((2, 1000), (2, 0), (20_000, 1000)):     # by broadcast, by shuffles, no such node
        monkeypatch.setattr(reference, "HOT_NODE", hot)
        monkeypatch.setattr(reference, "HOT_STEPS", few)
        rows = [tuple(x) for x in reference.implied_permissions(e, s).collect()]
        assert len(rows) == len(want) and {x[:5]: x[5] for x in rows} == want


def test_postings_of_a_task_are_one_row_a_run(spark, tmpdir_path):
    df = spark.createDataFrame([(k, f"the same words {k % 7} \U0001F600\U0001F600\U0001F600") for k in range(500)],
                               "id long, body string").coalesce(1)
    index = TrigramIndex(spark, tmpdir_path, 4, 4)
    index.add("doc", df, "id", "body", 1)
    rows = index.grams.read().collect()
    tasks = index.texts.read().rdd.getNumPartitions()
    grams = {t[k:k + 3] for k7 in range(7) for t in [f"the same words {k7} \U0001F600\U0001F600\U0001F600"] for k in range(len(t) - 2)}
    assert {x["gram"] for x in rows} == grams and len(rows) <= tasks * len(grams)
    assert sum(len(x["object_ids"]) for x in rows) == 500 * 18
