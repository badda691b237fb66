import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from noticelake.llm import repetition
from noticelake.llm.repetition import Rules


def by_hand(text, rules):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def covered(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        seen = Counter(grams)
        return {k for i, g in enumerate(grams) if seen[g] > 1 for k in range(i, i + n)}

    lines, dup, chars = set(), 0, 0
    for line in text.split("\n"):
        got = re.findall(r"[^\x20\x09-\x0D]+", line)
        if got and line in lines:
            dup, chars = dup + 1, chars + sum(map(len, got))
        elif got:
            lines.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered(rules.repeat_size)), chars,
            *[sum(len(words[i]) for i in covered(n)) for n, _ in rules.covered]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "世界", "#x|", "<", "\n", "a b a b", "\n\n", "\x0b", " "]), max_size=60))
def test_counts_by_hand(parts):
    rules = Rules(repeat_size=2, covered=((1, 50), (3, 50)))
    text = " ".join(parts)
    assert repetition.measure(text.encode(), rules) == by_hand(text, rules)


def test_verdicts(spark):
    fine = " ".join(f"word{i}" for i in range(40))
    rows = [(1, fine), (2, "too short"), (3, None), (4, " ".join(["again"] * 40)), (5, "\n".join([fine[:60]] * 9 + [fine])),
            (6, fine.replace(" ", "*** ")), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in repetition.verdicts(docs).collect()}
    assert {i for i, r in found.items() if r.kept} == {1}
    assert {i for i, r in found.items() if r.base_failed} == {2, 3, 4, 5, 7}


def test_awkward_rows(documents, nothing):
    found = sorted((r.doc_id or 0, r.n_words, r.word_chars) for r in repetition.verdicts(documents).collect())
    assert found == sorted((r.doc_id or 0, *by_hand(r.text, Rules())[:2]) for r in documents.collect())
    kept = repetition.keep_good(documents)
    assert kept.columns == documents.columns and kept.where("rules = 'x' or rules = 'z'").count() == kept.count() > 0
    assert repetition.verdicts(nothing).count() == repetition.keep_good(nothing).count() == 0
