"""Restoring of spellings, and held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import SMALL_DATA
from pyspark.sql import functions as F

from shopmetrics.llm import toxicity as X
from shopmetrics.llm.queries import op4_toxicity


@pytest.fixture(scope="module")
def restorer(spark):
    words = "idiot stupid loser moron scum pathetic the and of house other people".split()
    texts = [(" ".join(words * 20),), (None,), ("",)]
    return X.Restorer(X.character_model(spark.createDataFrame(texts, "text string")))


@pytest.mark.parametrize(
    "seen,word",
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("looooser", "loser"),
     ("st*pid", "stupid"), ("$cum", "scum"), ("P4TH3T!C", "pathetic"), ("st​upid", "stupid"),
     ("L-O-S-E-R!!", "loser")],
)
def test_restores(restorer, seen, word):
    tokens = restorer.tokens(f"so {seen} they said", True)
    assert word in {w for t in tokens for w in restorer.words(t)}


@pytest.mark.parametrize(
    "seen,word",
    [("l" + 40 * "o" + "ser", "loser"), ("/".join(["m0ron", "st*pid", "idi0t"] * 4), "idiot"),
     (" ".join("theotherpeopleofthehouseandthestupidloser"), "stupid")],
)
def test_restores_long_spots(restorer, seen, word):
    assert len(seen) > 40
    tokens = restorer.tokens(f"so {seen} they", True)
    assert word in {w for t in tokens for w in restorer.words(t)}


def test_long_spots_take_linear_time(restorer):
    rng = random.Random(0)
    seen = "".join(rng.choice("aeiost150$*.-") for _ in range(20_000))
    assert len(restorer.decode(seen)) > 5_000


@pytest.fixture(scope="module")
def short_words():
    words = "ass dumbass kill cunt idiot shit letter the and of house rap music".split()
    table = X.gram_table(words, np.full(len(words), 6.0))
    return X.Restorer(X.CharacterModel(table.astype(np.float32)))


@pytest.mark.parametrize(
    "seen,word",
    [("a$$", "ass"), ("a55", "ass"), ("ki11", "kill"), ("dumba$$,", "dumbass"), ("shi+", "shit"),
     ("(unt", "cunt"), ("\"(unt\"", "cunt"), ("ki!!", "kill"), ("iddiott", "idiot"),
     ("iidiot!", "idiot"), ("(a$$)", "ass"), ("a.$.$", "ass"), ("a-5-s", "ass")],
)
def test_restores_endings_and_edges(short_words, seen, word):
    assert word in {w for t in short_words.tokens(f"so {seen} they", False) for w in short_words.words(t)}


def test_edges_are_marks_where_words_are_likelier(short_words):
    tokens = short_words.tokens("(the rap music! letter (rap) and house!!", False)
    words = {w for t in tokens for w in short_words.words(t)}
    assert words == {"the", "rap", "music", "letter", "and", "house"}


def test_slots():
    grams = ["a", " th", "ab€c", "  й", "語"]
    for g in grams:
        columns = np.array([[ord(c)] for c in g], dtype=np.uint32)
        assert X.CharacterModel.slot(g) == X.slots(columns)[0]


def test_plain_words_stay(restorer):
    tokens = restorer.tokens("The other people, and (some) words.", False)
    words = {w for t in tokens for w in restorer.words(t)}
    assert words == {"the", "other", "people", "and", "some", "words"}


def test_decoding_is_the_best_path(restorer):
    """Viterbi finds what a search of all paths finds."""
    seen = "1d10tt"

    def paths(places, state, score, text):
        if not places:
            yield score + restorer.model.cost(state, " ", {}), text
            return
        for letter, channel in places[0]:
            now, total = state, score + channel
            if letter:
                total += restorer.model.cost(state, letter, {})
                now = (state + letter)[1:] if letter != " " else "   "
            yield from paths(places[1:], now, total, text + letter)

    best = max(paths(restorer.lattice(seen), "   ", 0.0, ""))
    assert restorer.decode(seen) == best[1]


def test_spaced_out():
    import pyarrow as pa

    texts = ["a b c", "a b", "é\nx y", "aa b c", "", None, "x a b c d", "a b", "c"]
    assert X.spaced_out(pa.array(texts)) == [True, False, True, False, False, False, True, False, False]


def test_held_out_accuracy(spark):
    rows = op4_toxicity(spark, SMALL_DATA.replace("0.001", "0.01"))
    labels = spark.read.parquet(SMALL_DATA.replace("0.001", "0.01") + "/labels.parquet")
    held = rows.where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    assert len(held) > 50
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == (r.score >= 0.5) for r in held)


def test_odd_rows(spark):
    rng = random.Random(0)
    some = lambda: " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(9))
    texts = [(i, some() + (" idiot " if i % 2 else " fine ") + some(), 1, 2.0) for i in range(60)]
    texts += [(None, "you idiot"), (101, None), (102, ""), (103, "idi0t " * 30_000), (103, "same id")]
    schema = "doc_id long, text string, predicted int, score double"
    docs = spark.createDataFrame([(*t, 1, 2.0)[:4] for t in texts], schema)
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int"
    )
    got = X.toxicity(docs, labels).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].predicted == 1 and not by_id[None].held_out
    assert by_id[101].score == by_id[102].score and not math.isnan(by_id[101].score)
    assert {r.predicted for r in got if r.doc_id == 103} == {0, 1}
    none = X.toxicity(docs, labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert X.toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_used(spark):
    texts = [(i, f"{'bad' if i % 2 else 'good'} n{i} o{i} p{i} q{i}") for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (
        {r.doc_id: r.score for r in X.toxicity(docs, x).collect()} for x in (labels, turned)
    )
    assert one == two


def test_rare_toxic_words_beside_a_large_group_of_copies(spark):
    """What few documents hold is learnt, however many toxic near copies there are."""
    rng = random.Random(1)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = some(60)
    texts = [(f"{passage} vile c{i}", 1) for i in range(1500)]
    texts += [(f"{some(20)} scum {some(20)}", 1) for _ in range(12)]
    texts += [(f"{some(20)} fine {some(20)}", 0) for _ in range(1500)]
    rows = [(i, *t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = spark.sparkContext.broadcast(X.character_model(docs))
    fitted = X.fit(docs.drop("toxic"), docs.drop("text"), model)
    assert fitted.weights.get("scum", 0.0) >= 0.5
    assert "fine" not in fitted.weights


def test_weights_of_near_copies(spark):
    """Only documents linked by five-word shingles at 0.8 share a weight."""
    rng = random.Random(2)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage, copied = some(40), some(100)
    texts = [f"{some(60)} {passage} {some(60)}" for _ in range(300)]  # share a passage only
    texts += [f"{copied} e{i}" for i in range(20)]
    texts += ["", "two words", None]
    sample = spark.createDataFrame(list(enumerate(texts)), "document long, text string")
    got = {r.document: r.weight for r in X._weighted(sample).collect()}
    groups = brute.jaccard_components(list(enumerate(texts)), 5, 80, 100)
    size = Counter(c for _, c in groups.values())
    assert got == {d: pytest.approx(1 / size[c]) for d, (_, c) in groups.items()}
    assert got[0] == 1.0 and got[300] == pytest.approx(1 / 20)


def test_unread_spots_change_no_score(short_words):
    rng = random.Random(3)
    weights = {"ass": 0.9, "dumb-": 0.7, "cunt": 0.6, "idiot": 0.8, "shit-": 0.75, "letter": 0.3}
    tokens = [
        "".join(rng.choice("aassdumbcntiilleetrrkh15$@!*.-/(") for _ in range(rng.randint(1, 12)))
        for _ in range(3000)
    ] + ["a$$", "iddiott", "dumba$$", "lettter", "(unt", "c.u.n.t", "k11l/a55", "rabbit", "$$$"]
    every = X.Restorer(short_words.model)
    plain, quick = X.WordScorer(weights, 0.1), X.WordScorer(weights, 0.1)
    pruned = X.Restorer(short_words.model, quick.heads)
    for token in tokens:
        assert quick.score({token}, pruned) == plain.score({token}, every), token
    assert len(pruned.known) < len(every.known) / 2


def test_readings_without_a_head_are_left_out_early():
    """What is ruled out early is what the whole lattice rules out, and weighs nothing."""
    model = X.CharacterModel(np.ones((X.ORDER, 1 << X.TABLE_BITS)))
    scorer = X.WordScorer({"stupid": 0.9, "fool-": 0.4, "abc": 0.6, "so": 0.3}, 0.1)
    restorer = X.Restorer(model, scorer.heads)

    def readings(seen):
        found = {""}
        for options in restorer.lattice(seen):
            found = {r + letter for r in found for letter, _ in options}
        return found

    draw = random.Random(5)
    early = 0
    for _ in range(2000):
        word = "".join(draw.choice("abcstupidofl1é") for _ in range(draw.randint(1, 6)))
        if draw.random() < 0.5:
            word = "".join(c * draw.choice([1, 1, 2]) for c in draw.choice(["stupid", "fool", "abc"]))
        heads = {w[: X.PREFIXES.start] for r in readings(word) for w in r.split(" ")}
        assert restorer.reaches(word) == (not heads.isdisjoint(scorer.heads)), word
        token = draw.choice(["", "(", '"']) + word + draw.choice(["", "!", ",", ")", "(", "$"])
        if restorer.weightless(token):
            early += 1
            assert {scorer.weight(w) for w in restorer.words(token)} == {0.0}, token
    assert early > 50
    tokens = {"plain,", "harmless", "été"}
    assert scorer.score(tokens, restorer) == 0.0 == scorer.score(tokens, restorer)
    assert scorer.weightless >= {"plain,", "harmless"} and not scorer.tokens


def test_spots_are_decoded_for_whole_features_only(short_words):
    """Equal scores, though a spot that merely begins like a feature isn't decoded."""
    rng = random.Random(4)
    weights = {"ass": 0.9, "dumb-": 0.7, "cunt": 0.6, "idiot": 0.8, "shit-": 0.75, "letter": 0.3, "stupid-": 0.9}
    tokens = ["".join(rng.choice("aassdumbcntiilleetrrkh15$@!*.-/(") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    tokens += [head + "".join(rng.choice("dtiiop1*$.s") for _ in range(rng.randint(0, 6))) for head in ("stu", "$tu", "lett", "id1", "cuu") for _ in range(200)]
    tokens += ["$tupid", "stuupiidly", "1ett3r", "1ett3rs", "c.u.n.t", "cuntt", "a$$", "iddiott", "idiotts", "k11l/a55", "$$$"]
    by_heads, exact = X.WordScorer(weights, 0.1), X.WordScorer(weights, 0.1)
    wide = X.Restorer(short_words.model, by_heads.heads)
    narrow = X.Restorer(short_words.model, exact.heads, exact.weights)
    for token in tokens:
        assert exact.score({token}, narrow) == by_heads.score({token}, wide), token
    assert narrow.reaches("1ett3r") and not narrow.reaches("1ett3rs") and wide.reaches("1ett3rs")
    assert len(narrow.known) < len(wide.known)
