import re
from collections import Counter

from helpers import AWKWARD, docs, same_as_sql
from signals.llm import quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


TEXTS = AWKWARD + ["a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h", " ".join(map(str, range(500))) * 2,
                   "x y z " * 4 + "\n" + "x y z " * 4, "a\r\nb\n\nb\n \n", "\x1c a\x0bb\x0cc"]


def test_base_counts_equal_brute_force(spark):
    out = {r["doc_id"]: r for r in quality.query(spark, docs(spark, TEXTS)).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r, c = out[i], counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c
        assert r["base_failed"] == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r["base_failed"] and r["kept"])


def test_equals_sql(spark):
    assert same_as_sql(spark, "op3_quality_rules")


def test_no_shuffle_and_no_user_functions(spark):
    plan = quality.query(spark, docs(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_clashing_and_rules(spark):
    assert quality.query(spark, docs(spark, [])).count() == 0
    prose = "the cat and the dog of this house went to sea with an old friend and came back on the next day "
    df = docs(spark, [prose, prose + "### " * 30, "zxq " * 3 + " ".join(f"qq{i}" for i in range(40))]).selectExpr(
        "*", "1 AS n_words", "true AS kept", "'x' AS n_lines")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert kept == {0: True, 1: False, 2: False}
