"""Hard negatives and spelling variants against brute force, piece encoding against the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import hard_negatives as N
from linkloom.llm import piece_codec as P
from linkloom.llm import queries
from linkloom.llm import spelling_variants as V

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
LONG = "very long text " * 30_000


# hard negatives


def brute_negatives(rows, every=100):
    kept = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * float(x)) for x in v]
            if sum(x * x for x in whole) < 1 << 62:
                kept.append((i, whole, label))
    out = []
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = [sum(a * b for a, b in zip(v, w)) for _, w, _ in kept]
        order = lambda j: (-scores[j], kept[j][0] is None, kept[j][0] or 0, kept[j][2], j)
        own = sorted((j for j in range(len(kept)) if j != k and kept[j][2] == label), key=order)[:5]
        others = sorted((j for j in range(len(kept)) if kept[j][2] != label), key=order)
        for p in own:
            found = [j for j in others if 80 * scores[p] <= 100 * scores[j] <= 100 * scores[p]][:5]
            out += [(i, kept[p][0], n, kept[j][0], scores[p], scores[j]) for n, j in enumerate(found, 1)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], "vec_id long, embedding array<double>, label int, row string, block string").coalesce(3)


def mined(frame, **options):
    return Counter(tuple(r) for r in N.mine(frame, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_negatives_against_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=12)).round(2).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    assert mined(vectors(spark, rows), every=10) == brute_negatives(rows, 10)


def test_negatives_with_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist(), i % 2) for i in range(0, 60)]  # many ties
    rows += rows[:7] + [(0, rows[0][1], 1)] * 2  # repeated rows, one id with two labels
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 0), (None, [2.0, 2.0, 2.0, 2.0], 1)]
    rows += [(100, [1.0], 0), (101, [], 1), (200, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [math.nan, 1.0], 1), (303, [math.inf, 1.0], 1), (304, [1.0], None), (305, [1e300], 1)]
    assert mined(vectors(spark, rows), every=20) == brute_negatives(rows, 20)
    assert mined(vectors(spark, rows).where("false")) == Counter()
    assert mined(vectors(spark, rows[1:5])) == Counter()


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=3) * 2.0**21 + 2.0**22).tolist(), i % 3) for i in range(120)]
    assert max(s for *_, s in brute_negatives(rows, 10)) > 1 << 53
    assert mined(vectors(spark, rows), every=10) == brute_negatives(rows, 10)


def test_bounds_save_scores_where_anchors_are_near():
    """The walk keeps every interval around its score, and near anchors leave most rows unscored."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    near = (256 * (centre + 0.05 * rng.normal(size=(200, 32)))).round().astype(np.int64)
    rest = (256 * rng.normal(size=(4000, 32))).round().astype(np.int64)

    def of(m, first, label):
        columns = [pa.array(np.arange(first, first + len(m))), pa.array(np.arange(first, first + len(m))), pa.array(np.full(len(m), label)), pa.array(m.tolist())]
        return N.Vectors(pa.RecordBatch.from_arrays(columns, ["row", "id", "label", "vec"]), 32)

    block, rows = N.Block(of(near[:50], 0, 1)), of(np.concatenate([near[50:], rest]), 1000, 1)
    for at, low, high, _ in block.walk(rows):
        score = rows.whole @ block.anchors.whole[at]
        assert (low <= score).all() and (score <= high).all()
    search = N.Positives([N.Block(of(near[:50], 0, 1))], 5)
    search.add(rows)
    assert search.blocks[0].scored < 0.35 * search.blocks[0].asked
    for at, best in enumerate(search.best[0]):
        assert best.kept[0].tolist() == sorted((rows.whole @ near[at]).tolist(), reverse=True)[:5]


def test_spanning_tree_is_the_least_one():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(40, 5))
    order, parent, edge = N.spanning_tree(points)
    assert sorted(order) == list(range(40)) and parent[order[0]] == order[0]
    place = {int(x): k for k, x in enumerate(order)}
    assert all(place[int(parent[x])] < place[int(x)] for x in order[1:])
    links = sorted((float(np.linalg.norm(points[a] - points[b])), a, b) for a in range(40) for b in range(a))
    group = list(range(40))
    total = 0.0
    for length, a, b in links:  # joins the nearest groups first
        if group[a] != group[b]:
            total += length
            group = [group[a] if g == group[b] else g for g in group]
    assert math.isclose(edge.sum(), total, rel_tol=1e-9)


# spelling variants


def brute_variants(rows, slip):
    upper, counts = str.maketrans(V.UPPER, V.LOWER), Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            digest = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and digest % slip == 0:
                at = digest % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = sorted(set("".join(words)))
    near = {}
    for w in words:
        cut = {w[:k] + w[k + 1 :] for k in range(len(w))}
        put = {w[:k] + x + w[k:] for k in range(len(w) + 1) for x in letters}
        turned = {w[:k] + x + w[k + 1 :] for k in range(len(w)) for x in letters}
        near[w] = [x for x in cut | put | turned if x != w and x in words]
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f is not None and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def variants(frame, slip):
    rows = V.spelling_variants(V.word_counts(frame, slip=slip)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_variants_of_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = queries.op12_spelling_variants(spark, sf_dir)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(rows, 97)


def test_variants_of_odd_rows(spark):
    rng = random.Random(3)
    long = "é" * 70
    texts = ["colour " * 40 + "color " * 19 + "colr_ colro " * 4, "Colour coLor ÉTÉÉÉ étééé " * 3, None, "", "x" * 3000 + " " + long, LONG]
    texts += [f"{long} {long[1:]} {long[:-1]}a " * 3, "aaaaaa aaaaa aaaab aaaaaaa " * 5, " ".join(rng.choice(["abcde", "abcdf", "abcd", "bbcde"]) for _ in range(99))]
    chain = "".join(f"{w} " * n for w, n in (("aabbcc", 3), ("aabbcd", 6), ("aabbdd", 12), ("aabddd", 24), ("aadddd", 48), ("addddd", 96)))
    rows = [(k, t) for k, t in enumerate([*texts, chain])] + [(None, "colour colour"), (None, None), (1, texts[1]), (1, texts[1])]
    frame = spark.createDataFrame([(*r, "mine", 1, "mine") for r in rows], "doc_id long, text string, word string, n int, shard string")
    for slip in (None, 7):
        got = variants(frame, slip)
        assert got == brute_variants(rows, slip)
    assert ("aabbcc", "aabbcd", "addddd", 3, 1, 6) in variants(frame, None)
    assert variants(frame.where("false"), 97) == set()


def test_waves_and_split_shards_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(5, 8))) for _ in range(3000)})
    counts = spark.createDataFrame([(w, rng.randint(3, 400)) for w in words], "word string, n long")
    read = lambda: {tuple(r) for r in V.spelling_variants(counts).collect()}
    whole = read()
    monkeypatch.setattr(V, "BITS_PER_WORD", 200)  # several blocks a shard
    monkeypatch.setattr(V, "WAVE_BLOCKS", 3)
    assert read() == whole and len(whole) == len(words)


# pieces

ALPHABET = "ab  ▁éß日𝒳\n\t\x00<s>/ﬁ①Ａ́e​　q"
TEXTS = st.text(alphabet=st.sampled_from(ALPHABET), max_size=50)


@pytest.fixture(scope="module")
def codec():
    return P.PieceCodec(open(MODEL, "rb").read())


def from_library(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, out_type="proto").pieces]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(TEXTS, st.text(max_size=40)), max_size=6))
def test_pieces_and_spans_agree_with_the_library(texts):
    codec = test_pieces_and_spans_agree_with_the_library.__dict__.setdefault("codec", P.PieceCodec(open(MODEL, "rb").read()))
    assert codec.separable
    for text, (ids, begins, ends, decoded) in zip(texts, codec.encode(texts), strict=True):
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == from_library(codec.library, text)
        assert decoded == codec.library.decode(codec.library.encode(text))
        assert codec.written(ids).decode() == ",".join(map(str, codec.library.encode(text)))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", range(8))
def test_character_maps_against_the_library(rule, flags):
    rng = random.Random(flags)
    given_ = {"add_dummy_prefix": bool(flags & 1), "escape_whitespaces": bool(flags & 2), "remove_extra_whitespaces": bool(flags & 4)}
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **given_)
    ours = P.Normaliser(library.serialized_model_proto())
    pool = ALPHABET + "가각ÀÁẠ̃̀́ﷺ½㌀ｶﾞ"
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        want, offsets = library.normalize(text, with_offsets=True)
        got, source = ours(text.encode())
        assert got.decode() == want, text
        # the library counts characters, on both sides
        starts = [k for k, b in enumerate(got) if b & 0xC0 != 0x80] + [len(got)]
        at = {len(text[:k].encode()): k for k in range(len(text) + 1)}
        assert [at[int(source[k])] for k in starts] == list(offsets), text


def test_a_model_with_a_character_map(codec):
    """The same vocabulary behind another normaliser: spans lead back to the text as it was given."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    field = next(raw for n, _, raw in P.message_fields(spec.serialized_model_proto()) if n == 3)
    model = b"".join(raw for n, _, raw in P.message_fields(open(MODEL, "rb").read()) if n != 3) + field
    library, mapped = sentencepiece.SentencePieceProcessor(model_proto=model), P.PieceCodec(model)
    rng = random.Random(1)
    texts = ["", " ", "Ａ①  ﬁ x ", "  ½ ", "éé"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text, (ids, begins, ends, decoded) in zip(texts, mapped.encode(texts), strict=True):
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == from_library(library, text), text
        assert decoded == library.decode(library.encode(text))
    data = "Ａ①  ﬁ x ".encode()
    ids, begins, ends, _ = next(mapped.encode([data.decode()]))
    assert [data[a:b].decode() for a, b in zip(begins, ends, strict=True)][0].startswith("Ａ")


def test_piece_queries_on_odd_rows(spark, codec):
    rows = [(1, None), (2, ""), (3, "A b  c\td"), (3, "A b  c\td"), (None, "x ▁ y</s>"), (4, LONG), (5, " 日本𝒳"), (6, "0" * 100_000)]
    frame = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = Counter(tuple(r) for r in P.piece_digests(frame, MODEL).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, text in rows:
        ids = codec.library.encode(text or "")
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(codec.library.decode(ids)), len((text or "").encode()))] += 1
    assert got == want
    encoded = P.encode_pieces(frame, MODEL)
    for r in encoded.collect():
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        assert list(zip(r["ids"], r["begins"], r["ends"], strict=True)) == from_library(codec.library, text)
    decoded = Counter(tuple(r) for r in P.decode_ids(encoded, MODEL).collect())
    assert decoded == Counter((i, codec.library.decode(codec.library.encode(t or ""))) for i, t in rows)
    for run in (P.piece_digests, P.encode_pieces):
        assert run(frame.where("false"), MODEL).count() == 0
    assert P.decode_ids(encoded.where("false"), MODEL).count() == 0
    text_ids = frame.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert P.piece_digests(text_ids, MODEL).schema["doc_id"].dataType.simpleString() == "string"


def test_query_of_pieces_on_documents(spark, sf_dir, codec):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_sentencepiece(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = codec.library.encode(r["text"] or "")
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
