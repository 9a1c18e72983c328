"""Phrase counts and collocations beside a plain version."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from casemill.llm import phrases, tokens


def _dealt(rows):
    return pa.Table.from_batches(phrases._deal(iter(pa.Table.from_pylist(rows).to_batches())))


def counts_of(df):
    return {(r["lang"], tuple(r["phrase"].split(" ")) if r["width"] else ()): r["f"] for r in df.collect()}


def expected(rows, least):
    return {k: n for k, n in brute.phrase_counts(rows).items() if n >= least}


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 5000, "bucket_bytes": 900}])
def test_counts_of_samples(sample_docs, no_docs, sizes):
    rows = [(r["text"], r["lang"]) for r in sample_docs.collect()]
    assert counts_of(phrases.frequent_phrases(sample_docs, least=2, **sizes)) == expected(rows, 2)
    assert phrases.frequent_phrases(no_docs, **sizes).count() == 0 == phrases.collocations(no_docs, **sizes).count()


AWKWARD = [
    ("a b c d e", "x"), ("A b  C\td e", "x"), ("a b, c d e", "x"), ("a b\x0bc d", "x"), ("a b\x00 c d\x00", "x"), ("a\x01b \x7f", "x"),
    ("é É 日本 é É", None), ("é É 日本", "und"), ("", "x"), (None, "x"), (None, None), (" .,;:!?\n", "y"), ("a b c d e", ""), ("a b c d e", "z"),
    ("...a b...a b", "z"), ("w" * 300_000 + " " + "w" * 300_000, "z"),
]


def test_words_pieces_and_languages(spark):
    df = spark.createDataFrame(AWKWARD * 2, "text string, lang string").repartition(3)
    assert counts_of(phrases.frequent_phrases(df, least=1)) == expected(AWKWARD * 2, 1)


def test_collocations(spark):
    gen = random.Random(3)
    vocabulary = ["w%d" % k for k in range(40)]
    fixed = ["new york city", "as well as", "red, green", "New York"]
    rows = [(" ".join(gen.choice(fixed) if gen.random() < 0.2 else gen.choice(vocabulary) for _ in range(60)) + gen.choice([".", ""]), gen.choice(["en", "de", None])) for _ in range(150)]
    df = spark.createDataFrame(rows * 2, "text string, lang string").repartition(4)
    for top in (2000, 7):
        got = sorted(tuple(r) for r in phrases.collocations(df, top=top, group_bytes=20_000, bucket_bytes=4000).collect())
        assert got == brute.collocations(rows * 2, top=top) and len({r[0] for r in got}) == 3


def test_scores_are_exact_beyond_64_bits(spark):
    big = (1 << 62) - 7
    rows = [("x", 0, "", big), ("x", 1, "a", big), ("x", 1, "b", big - 2), ("x", 2, "a b", big - 3)]
    df = spark.createDataFrame(rows, "lang string, width int, phrase string, f long")
    found = phrases.scored_candidates(df).collect()
    assert [tuple(r) for r in found] == [("x", "a b", big - 3, big, big - 2, 2_000_000 * (big - 3) // (2 * big - 2))]
    nearly = [("x", 3, "a b c", 80), ("x", 2, "a b", 100), ("x", 2, "b c", 101), *[("x", 1, w, 200) for w in "abc"]]
    kept = phrases.scored_candidates(spark.createDataFrame(nearly, "lang string, width int, phrase string, f long")).collect()
    assert sorted(r["phrase"] for r in kept) == ["a b c", "b c"]


def test_equal_words_are_told_by_their_bytes():
    data, offsets = tokens.text_buffers(pa.array(["Ab ab aB cd abc x"]))
    words = tokens.find_words(data, offsets, phrases._TABLE)
    words.code[:] = 5  # every fingerprint collides
    for step in (1 << 17, 2):
        ids = phrases.word_ids(data, words.code, words.start, words.end, step)
        assert ids[0] == ids[1] == ids[2] and len(set(ids.tolist())) == 4


def test_colliding_fingerprints_are_counted_apart(monkeypatch):
    """With fingerprints of three bits nearly all phrases collide; the counts must not change."""
    mix = tokens.mix
    monkeypatch.setattr(tokens, "mix", lambda x: mix(x) & np.uint64(7 << 40))
    gen = random.Random(1)
    rows = [(" ".join(gen.choices("abcdefg", k=30)), gen.choice(["x", "y"])) for _ in range(12)]
    whole = [dict(lang=lang, text=text, g=k % 3) for k, (text, lang) in enumerate(rows)] * 2
    groups = [_dealt([r for r in whole if r["g"] == g]) for g in range(3)]
    found, answers = {}, None
    for widths in ((0, 1), (2,), (3, 4)):
        of = [answers and (answers.filter(pa.compute.equal(answers.column("g"), g)),) or () for g in range(3)]
        sent = pa.concat_tables([phrases._send(4, widths)(t, *a) for t, a in zip(groups, of)])
        buckets = [sent.filter(pa.compute.equal(sent.column("bucket"), b)) for b in range(4)]
        answers = pa.concat_tables([phrases._answer(2)(b) for b in buckets if b.num_rows])
        spelled = [phrases._spell(3)(t, answers.filter(pa.compute.equal(answers.column("g"), g))) for g, t in enumerate(groups)]
        told = pa.concat_tables(spelled)
        for b in range(3):
            mine = told.filter(pa.compute.equal(told.column("bucket"), b))
            for r in phrases._merge(2)(mine).to_pylist() if mine.num_rows else ():
                found[r["lang"], tuple(r["phrase"].split(" ")) if r["width"] else ()] = r["f"]
    want = {k: 2 * n for k, n in brute.phrase_counts(rows).items()}
    assert found == want


def test_only_frequent_fingerprints_are_answered():
    def cell(code, weight, place):
        return phrases._pack_codes(np.array(code, np.uint64)), phrases._pack(np.array(weight), np.array(place, np.uint32), np.ones(len(code), np.uint8))

    cells = [cell([1, 2], [3, 4], [10, 20]), cell([1, 3], [2, 1], [30, 40])]
    sent = pa.table({"bucket": [0, 0], "g": [0, 1], "codes": [c[0] for c in cells], "rest": [c[1] for c in cells]})
    told = phrases._answer(5)(sent)
    assert [r[1].tolist() for r in phrases._rest_of(told.column("rest"))] == [[10], [30]] and told.column("g").to_pylist() == [0, 1]
    assert [c.tolist() for c in phrases._codes_of(told.column("codes"))] == [[1], [1]]


def test_rare_parts_keep_longer_phrases_at_home():
    table = _dealt([{"lang": "x", "text": "a b c a b d", "g": 0}])
    words = phrases._send(1, (0, 1))(table)
    assert sorted(phrases._rest_of(words.column("rest"))[0][2].tolist()) == [0, 1, 1, 1, 1]
    pairs = phrases._send(1, (2,))(table, phrases._answer(2)(words))
    assert len(phrases._codes_of(pairs.column("codes"))[0]) == 1  # "a b" alone
    assert phrases._send(1, (3, 4))(table, phrases._answer(2)(pairs)).num_rows == 0


def test_an_entry_costs_little_more_than_its_fingerprint():
    """Places, of as many bits as the text is long, stay at home, and a fingerprint is no longer than it must be."""
    text = " ".join(map(str, np.random.default_rng(5).integers(0, 400, 100_000)))
    table, bits = _dealt([{"lang": "x", "text": text, "g": 0}]), len(text).bit_length() + phrases.SPARE_BITS
    pairs = phrases._send(1, (2,), bits)(table, phrases._answer(1)(phrases._send(1, (0, 1), bits)(table)))
    n = len(phrases._codes_of(pairs.column("codes"))[0])
    assert n > 50_000 and sum(len(cell) for c in ("codes", "rest") for cell in pairs.column(c).to_pylist()) < 2 * n


@pytest.mark.parametrize("bits", [1, 9, 64])
def test_phrases_are_found_again_by_short_fingerprints(bits):
    gen = random.Random(8)
    rows = [(" ".join(gen.choices("abcdef", k=25)) + ". a  b", gen.choice(["x", "y"])) for _ in range(8)] * 2
    table, answers = _dealt([{"lang": lang, "text": text, "g": 0} for text, lang in rows]), []
    for widths in ((0, 1), (2,), (3, 4)):
        answers.append(phrases._answer(4)(phrases._send(3, widths, bits)(table, *answers[-1:])))
    found = phrases._merge(4)(phrases._spell(1, bits)(table, pa.concat_tables(answers))).to_pylist()
    assert {(r["lang"], tuple(r["phrase"].split(" ")) if r["width"] else ()): r["f"] for r in found} == expected(rows, 4)


def test_cells_round_trip():
    gen = np.random.default_rng(1)
    code = np.sort(gen.integers(0, 1 << 63, 1000).astype(np.uint64))
    columns = gen.integers(0, 1 << 60, 1000), gen.integers(0, 1 << 31, 1000).astype(np.uint32), gen.integers(0, 5, 1000).astype(np.uint8)
    assert (phrases._codes_of(pa.chunked_array([[phrases._pack_codes(code)]]))[0] == code).all()
    back = phrases._rest_of(pa.chunked_array([[phrases._pack(*columns)]]))[0]
    assert all((a == b).all() for a, b in zip(back, columns))
    langs, lang, count = ["a\n", "é"], np.array([0, 0, 1], np.int32), np.array([7, 1 << 40, 2])
    rows = phrases._unpack_phrases(phrases._pack_phrases(langs, lang, count, "\né x\ny\n".encode())).to_pylist()
    assert [(r["lang"], r["phrase"].decode(), r["f"]) for r in rows] == [("a\n", "\n", 7), ("a\n", "é x\n", 1 << 40), ("é", "y\n", 2)]


def test_phrases_are_cut_out_with_single_spaces():
    texts = pa.array(["Aa  b\tC d", "", "e f\x00 G"])
    data, offsets = tokens.text_buffers(texts)
    starts = tokens.find_words(data, offsets, phrases._TABLE).start
    place, width = np.concatenate([starts[[0, 0, 2, 4, 5]], starts[:1]]), np.array([4, 1, 2, 3, 2, 0])
    found, mark = phrases._phrases_at(data, offsets, place, width)
    assert [p[:-1] for p in found.to_pylist()] == [b"aa b c d", b"aa", b"c d", b"e f\x00 g", b"f\x00 g", b""]
    assert len(set(mark.tolist())) == 6
