import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticelake.llm import audit


def failed(rows):
    """The filters each (doc_id, text) row fails, by the definition of each."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({f for f, bad in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)}.items() if bad})
    return out


def brute_force(rows, good, toxic):
    """Every order run filter by filter over the rows of a part."""
    found = set()
    fails = failed(rows)
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, r[0]) for i, r in enumerate(rows) if (r[2] or "") == part]
        total = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in fails[x[0]]]
                left = [x for x in left if f not in fails[x[0]]]
                failing = [x for x in mine if f in fails[x[0]]]
                total[f] += len(removed)
                steps.append((part, "".join(order), step, len(left), len(removed), len(failing) - len(removed),
                              sum(fails[i] == {f} for i, _ in failing), sum(d in good for _, d in removed),
                              sum(d in toxic for _, d in removed)))
        found |= {(*s, total[s[1][s[2] - 1]]) for s in steps}
    return found


@pytest.fixture
def labels(spark):
    rows = [(1, 1, 0, "x"), (2, 0, 1, "x"), (2, 1, None, "x"), (6, None, 1, "x"), (7, 1, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, key string")


def test_equals_every_order_run_by_hand(documents, labels):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    got = audit.audit(documents, labels)
    assert {tuple(r) for r in got.collect()} == brute_force(rows, {1, 2, 7}, {2, 6, 7})
    assert got.columns[:3] == ["part", "filter_order", "step"]


def test_texts_that_just_pass_and_just_fail(spark):
    def words(n, distinct):
        return " ".join(f"w{i % distinct}" for i in range(n))

    texts = [words(199, 199), words(200, 200), words(200, 100), words(200, 99), "A" * 2 + "b" * 98, "A" * 3 + "b" * 97,
             "ÀÉ" * 50, "a|b", "\x0b \x0c", "\x1c" * 3, words(400, 200) + " *"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    facts = {r.doc_id: set(r.fails) for r in audit.facts(docs).collect()}
    assert [facts[i] | (f & {"E"}) for i, f in enumerate(failed(rows))] == failed(rows)


def test_no_documents(nothing, labels):
    assert audit.audit(nothing, labels).collect() == []


def test_a_large_group_of_copies_is_one_kept_and_the_others_removed(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = audit.audit(docs, labels).where("filter_order = 'EABCD' and step <= 2").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant) for r in row] == [(1, 2999, 0), (0, 1, 2999)]


def test_id_joins_use_one_exchange_per_table(spark, documents, labels):
    from noticelake.llm.common import stored

    rows = stored(audit.facts(documents))
    failing = audit.failing_ids(rows)
    plan = audit.classes(audit.labelled(rows, labels), failing)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
