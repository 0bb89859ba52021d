import zlib
from unittest import mock

import numpy as np
import pytest
from helpers import AWKWARD, docs, read
from signals.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d = read(spark, "documents", SF)
    lang = {r["doc_id"]: r["lang"] for r in d.collect()}
    rows = language.query(spark, d).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(read(spark, "documents", SF))


def test_levels(model):
    assert {m[0] for m in model.machines} == {"", "germanic", "romance"} and len(model.machines) == 3


def test_awkward_rows(spark, model):
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs(spark, AWKWARD), model).collect()}
    assert len(out) == len(AWKWARD)
    for i, t in enumerate(AWKWARD):
        has_letter = any(c.isalpha() for c in t or "")
        assert (out[i][0] == "und") == (not has_letter) and (has_letter or out[i][1] == 0.0)
    assert out[7] == out[8]
    assert language.identify(docs(spark, []), model).count() == 0
    clash = docs(spark, ["the cat"]).selectExpr("*", "1 AS score", "'q' AS lang_pred", "0 AS z")
    assert language.identify(clash, model).columns == ["doc_id", "text", "lang", "source", "n_chars", "z", "lang_pred", "score"]


def test_little_to_learn_from(spark):
    assert language.fit(docs(spark, [])) is None
    assert language.fit(docs(spark, ["a", "b"], ids=[None, None])) is None
    assert language.fit(docs(spark, ["text", "1"], langs=[None, "en"])) is None
    assert [r["lang_pred"] for r in language.query(spark, docs(spark, ["some text"], langs=[None])).collect()] == ["und"]
    one = language.query(spark, docs(spark, ["some text"] * 8 + ["12"])).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0), ("und", 0.0)}
    unknown = docs(spark, ["aaa bbb", "ccc ddd"] * 12, langs=["xx", "yy"] * 12)
    assert {r["lang_pred"] for r in language.query(spark, unknown).collect()} == {"xx", "yy"}


def test_tournament_breaks_ties_by_margin_then_name():
    games = [(0, "a", "b"), (1, "a", "c"), (2, "b", "c")]
    best, won = language.tournament(["a", "b", "c"], games, np.array([[1.0, -1.0, 0.5], [1.0, -1.0, 1.0], [-1.0, 0.0, -3.0]]))
    assert best.tolist() == [2, 0, 2] and ((0 <= won) & (won <= 1)).all()


def test_all_languages_are_learned(spark):
    """More than a hundred languages, one of them with long texts only."""
    rng = np.random.default_rng(1)
    langs = [f"l{k:03d}" for k in range(119)] + ["en"]
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(6)] for _ in langs]
    rows = [(lang, " ".join(rng.choice(w, 30 if lang != "en" else 5000))) for lang, w in zip(langs, words) for _ in range(6)]
    frame = docs(spark, [r[1] for r in rows], langs=[r[0] for r in rows])
    model = language.fit(frame)
    assert model.languages == sorted(langs) and len(model.machines) < 120 * 16
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame, model).collect()}
    assert sum(out[i] == r[0] for i, r in enumerate(rows)) > 0.97 * len(rows)
    assert all(out[i] == "en" for i, r in enumerate(rows) if r[0] == "en")


def test_rows_that_repeat_an_id_reach_the_driver_once(spark):
    df = docs(spark, [f"some text {chr(97 + k % 26)}" for k in range(3000)] + ["other text"] * 40, ids=[1] * 3000 + list(range(2, 42)))
    sizes, collect = [], type(df).collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    with mock.patch.object(type(df), "collect", counted):
        assert language.fit(df).languages == ["en"]
    assert 1 < max(sizes) <= 41


def test_whole_texts_teach_and_a_language_of_long_texts_is_learned(spark, monkeypatch):
    """No text is cut: those over the limit teach nothing, unless their language has no others."""
    monkeypatch.setattr(language, "TRAIN_CHARS", 60)
    seen = {}
    monkeypatch.setattr(language, "fit_texts", seen.update)
    rows = [(i, f"kurzer text nummer {i} " + "und so weiter " * (i % 2) * 9, "de") for i in range(40)]
    rows += [(100 + i, "una frase larga " * (9 + i % 3), "es") for i in range(30)]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {t for _, t, _ in rows}
    assert set(seen) == {"de", "es"} and all(t in texts for v in seen.values() for t in v)
    assert all(len(t) <= 60 for t in seen["de"]) and {len(t) for t in seen["es"]} == {144}
