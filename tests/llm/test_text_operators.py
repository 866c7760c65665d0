"""Text operators against brute force, the libraries themselves, and round trips."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import (
    binary_output, chat_format, decontamination, html_extraction, jaccard_join, language_id, line_frequency, lm_scoring, mixing,
    queries, token_counts,
)
from linkloom.llm.common import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, token string"
LONG = "long words in a very long text " * 20_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "A b  c\td", "en", "a", 0), (3, "A b  c\td", "en", "a", 0), (None, "x y z", "de", None, 5),
    (4, "...", None, "b", 3), (5, LONG, "en", "a", 1), (6, LONG + "end", "en", "a", 1), (7, "a B C d", "fr", "b", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "mine", "mine") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_odd_rows_and_empty_tables(spark, odd):
    model, bpe = queries.tokenizer_path("piece_bpe_32k.model"), queries.tokenizer_path("byte_bpe_50k.json")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "long words in a very long text long words")], "item_id long, text string")
    runs = {
        "lines": lambda d: line_frequency.quality_rules(d),
        "mix": lambda d: mixing.mix(d),
        "jaccard": lambda d: jaccard_join.jaccard_components(d, n=3, percent=90),
        "tokens": lambda d: token_counts.count_tokens(d, scratch_path(spark, "cache"), model),
        "lm": lambda d: lm_scoring.score_texts(d, lm_scoring.learned_from(F.col("doc_id"))),
        "ids": lambda d: binary_output.round_trip(d, bpe),
        "language": lambda d: language_id.predict(d, language_id.train(language_id.train_allowed(d))),
    }
    for name, run in runs.items():
        assert run(odd).count() == len(ROWS), name
        assert run(odd.where("false")).count() == 0, name
    hit = sorted(r["doc_id"] for r in decontamination.contaminated(odd, bench).collect())
    assert hit == [5, 6]
    assert decontamination.decontaminate(odd, bench).count() == len(ROWS) - 2
    assert decontamination.contaminated(odd, bench.where("false")).count() == 0
    kept = jaccard_join.near_duplicates_removed(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, None, 4, 5])
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_line_frequency_cuts_common_lines(spark):
    line = "this line stands in every document"
    rows = [(i, f"{line}\nown words of number {i} and some more of them here {i * 7}", "s") for i in range(30)] + [(99, "\n".join([line.upper()] * 2), "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in line_frequency.quality_rules(d).collect()}
    assert all(found[i]["n_cut_words"] == 6 and found[i]["kept"] for i in range(30))
    assert found[99]["n_cut_lines"] == 2 and not found[99]["kept"]
    text = d.where("doc_id = 3").select(line_frequency.without_lines(F.col("text"), F.array(*[F.lit(x) for x in found[3]["cut_lines"]]))).first()[0]
    assert text == "own words of number 3 and some more of them here 21"


def test_language_held_out(docs):
    model = language_id.train(language_id.train_allowed(docs))
    rows = language_id.predict(docs, model).where(language_id.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_training_takes_each_text_once(spark, monkeypatch):
    """A row repeated thousands of times is one text, and no language gives more than the bound."""
    rows = [(7, "the same words again", "en")] * 3000 + [(i, f"words of number {i}", "en") for i in range(100, 160)] + [(i, f"wort nummer {i}", "de") for i in range(5)]
    got = []
    monkeypatch.setattr(language_id, "fit", lambda x, labels: got.append((len(x), Counter(labels))))
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), per_language=40)
    assert got == [(45, Counter(en=40, de=5))]


def test_mix_of_many_equal_rows(spark):
    """More equal rows than a run holds: each is a row of the result, and they share their copies."""
    n = 2 * mixing.RUN + 5
    d = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("a").alias("source"))
    d = d.unionByName(spark.createDataFrame([(1, "other words here", "a"), (2, "x", "b")], d.schema))
    rows = mixing.mix(d).collect()
    assert len(rows) == n + 2
    equal = [r for r in rows if r["doc_id"] is None]
    assert len(equal) == n and {r["taken"] for r in equal} <= {2, 4}
    assert abs(sum(r["taken"] for r in rows if r["source"] == "a") - next(r["target"] for r in equal)) <= 3


def test_mixed_documents_with_clashing_names(spark):
    names = ["_size", "_n", "_i", "_s", "_z", "_all", "_copies", "_copy", "_place", "row", "_id", "_source"]
    rows = [(k % 3, "one two three", "s", *[f"{c}{k}" for c in names]) for k in range(9)]
    d = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = mixing.mixed_documents(d)
    assert got.columns == d.columns
    copies = Counter(map(tuple, got.collect()))
    assert set(copies) <= set(rows) and set(copies.values()) <= {1, 2} and abs(3 * sum(copies.values()) - 3 * 1.5 * 9) <= 3


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    taken, target, most, total = Counter(), {}, Counter(), 0
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        total += r["size"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, n, percent):
    sets = {}
    for r in docs.collect():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in lists[s])
        for s in sets[i]:
            lists[s].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, n=n, percent=percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


TEXT = st.text(st.sampled_from("ab'. \n\t\x1c ▁é日1|<>"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_parts_give_what_the_libraries_give(texts):
    counter, encoder = COUNTER, ENCODER
    texts = [*texts, "x <|endoftext|> y", "it's  I'll"]
    assert counter.counts(texts) == [len(x) for x in counter.library.encode(texts)]
    want = [np.array([*encoder.library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
    assert encoder.encode(texts, 2) == want


COUNTER = token_counts.PieceCounter(queries.tokenizer_path("piece_bpe_32k.model"))
ENCODER = binary_output.ByteEncoder(queries.tokenizer_path("byte_bpe_50k.json"))


def test_token_cache_encodes_only_what_is_new(spark, docs):
    cache, model = scratch_path(spark, "cache"), queries.tokenizer_path("piece_bpe_32k.model")
    assert token_counts.count_tokens(docs.where("doc_id < 200"), cache, model).where("cached").count() == 0
    again = token_counts.count_tokens(docs.where("doc_id < 300"), cache, model)
    assert again.where("doc_id < 200 and not cached").count() == 0
    assert spark.read.parquet(cache).groupBy("content").count().where("count > 1").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 7), st.integers(0, 1 << 31)), max_size=600))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint32)
    words_, _ = binary_output.pack(ids)
    assert (binary_output.unpack(words_, len(ids)) == ids).all()
    block = binary_output.encode_block(ids)
    for start in {0, len(ids) // 2, max(0, len(ids) - 1)}:
        assert (binary_output.decode_block(len(ids), **block, start=start) == ids[start:]).all()


def test_ids_from_files(docs):
    at, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = [*ENCODER.library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = binary_output.round_trip(docs, queries.tokenizer_path("byte_bpe_50k.json")).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_chat_round_trip(spark):
    text = "</s>[INST] ok [/INST] \\ <\\| <|im_end|>\n$1"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 1, "assistant", text), (2, 0, None, None), (None, 0, "assistant", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in chat_format.read_back(chat_format.format_conversations(d, scratch_path(spark, "chat"))).collect()}
    for conv in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(own), len(loss))
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 3, 9.0), (1, 5, 3, 0.0), (2, 6, 77, 1.0)]
    d = spark.createDataFrame(rows, "tree long, message long, parent long, score double")
    got = sorted((r["tree"], r["rank"], r["place"], r["message"]) for r in chat_format.best_paths(d, keep=2).collect())
    assert got == [(1, 1, 0, 1), (1, 1, 1, 3), (1, 1, 2, 4), (1, 2, 0, 1), (1, 2, 1, 2), (2, 1, 0, 6)]


def test_wrapper_cuts_constant_and_marked_parts(spark):
    page = "<html><title>t{0}</title><nav>m{0}</nav><div>Same on all pages</div><div class='box'><p>one &amp; {0}<p>two  <b>{0}</b></div><footer>f{0}</footer><script>s</script>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(6)] + [(9, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_text(d).collect()}
    assert got == {**{i: f"one & {i}\ntwo {i}" for i in range(6)}, 9: ""}


def test_edited_items_are_found():
    rng = np.random.default_rng(3)
    items = [[f"w{rng.integers(5000)}" for _ in range(rng.integers(8, 60))] for _ in range(100)]
    index = decontamination.build_index(list(range(100)), [" ".join(w) for w in items])
    found = 0
    for k, w in enumerate(items):
        w = list(w)
        for _ in range(decontamination.allowed_edits(len(w))):
            w[rng.integers(len(w))] = f"z{rng.integers(10**6)}"
        text = [f"v{x}" for x in rng.integers(10**6, size=50)]
        import pyarrow as pa

        for _, _, hashes, first in decontamination._slices(pa.array([" ".join(text[:20] + w + text[20:])])):
            found += any(item == k for _, item, *_ in decontamination.matches(index, hashes, first))
    assert found >= 95


def test_language_model_beats_its_base(docs):
    rows = [r for r in lm_scoring.score_texts(docs, lm_scoring.learned_from(F.col("doc_id"))).collect() if not r["learned"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    train = [d for d in docs.collect() if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2]
    n = sum(len(words(d["text"])) + 1 for d in train)
    assert all(r["train_tokens"] == n for r in rows)


def test_every_component_keeps_a_document(spark):
    text = lambda k, extra="": " ".join(f"w{k}x{i}" for i in range(40)) + extra
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0)), (None, text(1, " more")), (7, text(20)), (7, text(21)), (8, text(20)), (9, text(5))]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in jaccard_join.near_duplicates_removed(given).collect())
    # a null id goes where its component has an id; of two linked texts without ids either may stay
    either = [sorted([*((0, text(k)) for k in (0, 2, 3, 4)), (0, one), (7, text(20)), (7, text(21)), (9, text(5))]) for one in (text(1), text(1, " more"))]
    assert kept in either


def test_ngrams_are_sent_where_both_shorter_ones_are_kept(spark, monkeypatch):
    alone = [" ".join(f"w{k}x{i}" for i in range(200)) for k in range(4)]
    rows = list(enumerate([*alone, "a b c d", "a b c e", "b c d a b c f", None, "a b g b c"]))
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    sent, exchanged = set(), lm_scoring._exchanged

    def watched(asked, *rest):
        for r in asked.where("level = 3").collect():
            sent.update(lm_scoring._unpack(r["keys"]).tolist())
        return exchanged(asked, *rest)

    monkeypatch.setattr(lm_scoring, "_exchanged", watched)
    lm_scoring.score_texts(given, F.lit(True)).collect()
    # pairs that occur twice: a b, b c, c d; a word at a text's end and the end token do not
    assert len(sent) == 2


@pytest.mark.parametrize("order", [1, 2, 4])
def test_scores_do_not_depend_on_slices(spark, order):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(6, size=rng.integers(0, 30))), k % 3 > 0) for k in range(60)]
    given = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    one, many = (
        {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(d, F.col("learn"), order=order).collect()}
        for d in (given.coalesce(1), given.repartition(7, "doc_id"))
    )
    assert one == pytest.approx(many, rel=1e-12)


def test_rare_ngrams_stay_in_a_large_corpus(spark):
    texts = ["same " * 2_200_000, "one rare phrase", "and one rare phrase here", "here one rare end", "", "one rare phrase twice", "same same one rare"]
    rows = [(k, t, k < 5) for k, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(4, "doc_id")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(given, F.col("learn")).collect()}
    read = [[*t.split(), None] for t in texts]
    count = [Counter(tuple(t[i : i + n]) for t in read[:5] for i in range(len(t) - n + 1)) for n in (1, 2, 3)]
    arcs = [{}, defaultdict(list), defaultdict(list)]
    for n in (1, 2):
        for gram, k in count[n].items():
            if k >= 2:
                arcs[n][gram[:-1]].append(k)

    def chance(before, word):
        p = (count[0][word,] + 1) / (sum(count[0].values()) + len(count[0]) + 1)
        for n in range(1, min(2, len(before)) + 1):
            state = tuple(before[-n:])
            if kept := arcs[n].get(state):
                k = count[n][*state, word]
                p = p * max(1 - sum(x - 0.75 for x in kept) / count[n - 1][state], 1e-9) + (k - 0.75 if k >= 2 else 0) / count[n - 1][state]
        return p

    for k in range(1, len(texts)):
        assert got[k] == pytest.approx(sum(np.log10(chance(read[k][:i], w)) for i, w in enumerate(read[k])), rel=1e-9), k


@pytest.mark.parametrize("size", [1, 2, 5, 8, 40, 100, 400])
@pytest.mark.parametrize("how", ["opening", "deletions", "mixed", "insertions"])
@pytest.mark.parametrize("lead", [0, 30])
def test_every_match_is_found(size, how, lead):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    items = [[f"w{rng.integers(5000)}" for _ in range(size)] for _ in range(10)]
    index = decontamination.build_index(list(range(10)), [" ".join(w) for w in items])
    edits = decontamination.allowed_edits(size)
    for k, w in enumerate(items):
        at = sorted(rng.choice(size, edits, replace=False).tolist(), reverse=True)
        w = list(w)
        for j in range(edits) if how == "opening" else at:
            kind = {"opening": 0, "deletions": 0, "insertions": 1}.get(how, j % 3)
            w[0 if how == "opening" else j : (0 if how == "opening" else j) + (kind != 1)] = [] if kind == 0 else [f"z{rng.integers(10**6)}"]
        text = " ".join([f"v{x}" for x in range(lead)] + w + [f"u{x}" for x in range(60)])
        for _, _, hashes, first in decontamination._slices(pa.array([text])):
            assert any(item == k for _, item, *_ in decontamination.matches(index, hashes, first)), k


def test_wrapper_is_made_from_all_pages(spark):
    """A notice that some pages lack, whichever they are, and an empty page, are no reason to keep it."""
    page = "<div class='body'><p>story {0}</div>"
    full = "<div class='box'>Same notice</div>" + page
    rows = [(h * 100 + i, f"http://h{h}/{i}", (page if i == 0 else full).format(i)) for h in range(12) for i in range(20)]
    rows += [(h * 100 + 50, f"http://h{h}/50", None) for h in range(12)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_text(d).collect()}
    assert got == {r[0]: f"story {r[0] % 100}" if r[2] else "" for r in rows}


def test_constant_nodes_beside_varying_ones_are_template(spark):
    page = "<div>Same first</div><div class='b'><p>Same before<p>story {0}<p>more {0}<p>Same after</div><div>own {0}</div>"
    d = spark.createDataFrame([(i, f"http://h/{i}", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_text(d).collect()}
    assert got == {i: f"story {i}\nmore {i}\nown {i}" for i in range(6)}


def test_small_article_element_is_not_the_page():
    body = "<div><p>" + "a long body " * 20 + "</div>"
    assert "long body" in html_extraction.main_text(body + "<article>teaser</article>", None, None)
    assert html_extraction.main_text("<div>outside</div><article>" + body + "</article>", None, None) == ("a long body " * 20).strip()


def test_pipeline_keeps_texts_with_an_unsure_language(spark, docs, monkeypatch):
    import corpus_pipeline

    answer = F.when(F.col("doc_id") % 2 == 0, F.lit("en")).otherwise(F.lit(language_id.UNKNOWN))
    monkeypatch.setattr(language_id, "train_allowed", lambda d: d)
    monkeypatch.setattr(language_id, "train", lambda d: None)
    monkeypatch.setattr(language_id, "predict", lambda d, model: d.withColumn("lang_pred", answer).withColumn("score", F.lit(0.25)))
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.count() == docs.where("doc_id % 2 = 0").count() > 0


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar single", "home search-results", "widget", "page sidebar-right"])
def test_names_of_the_page_itself_say_nothing(name):
    page = f"<html class='{name}'><body class='{name}'><div class='search-page'><main class='{name}'><p id='related'>story</p></main></div></body></html>"
    assert html_extraction.main_text(page, None, None) == "story"


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "comment-list", "cookie-banner x", "ad", "newsletter_box"])
def test_named_boxes_are_dropped(name):
    page = f"<body><div class='{name}'><p>box</p></div><div class='a {name}'>box</div><div id='{name.split()[0]}'>box</div><p>story</p></body>"
    assert html_extraction.main_text(page, None, None) == "story"


def test_a_main_element_in_a_named_one_is_content():
    assert html_extraction.main_text("<div class='widget'>box<main><p>story</p></main>box</div>", None, None) == "story"


def test_pages_empty_repeated_and_very_long(spark):
    long = "<body>" + "".join(f"<p>part {i}</p>" for i in range(20_000)) + "</body>"
    rows = [(1, "http://h/1", long, 1), (2, None, None, 2), (3, "http://h/3", "", 3), (4, "http://h/1", "<p>a", 4), (4, "http://h/1", "<p>a", 4)]
    d = spark.createDataFrame(rows, "page_id int, url string, html string, slots long")
    got = sorted((r["page_id"], r["n_chars"], r["text"][:6]) for r in html_extraction.extract_text(d).collect())
    assert got == [(1, sum(len(f"part {i}") + 1 for i in range(20_000)) - 1, "part 0"), (2, 0, ""), (3, 0, ""), (4, 1, "a"), (4, 1, "a")]
    assert html_extraction.extract_text(d.where("false")).count() == 0


def test_rings_of_parents_are_left_out(spark):
    ring = [("r", 1, 2), ("r", 2, 3), ("r", 3, 1), ("r", 4, 3), ("r", 5, 5)]
    chain = [("c", 10 + i, 9 + i if i else None) for i in range(11)]
    d = spark.createDataFrame(ring + chain, "tree string, message long, parent long").withColumn("score", F.lit(1.0))
    got = [r["message"] for r in chat_format.best_paths(d).orderBy("place").collect()]
    assert got == list(range(10, 21))
    assert chat_format.best_paths(d.where("tree = 'r'")).count() == 0


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_ids_of_any_type(spark, kind):
    turns = spark.createDataFrame([(1, 0, "user", "a" * 300_000), (1, 1, "assistant", None)], "conv_id long, turn int, role string, text string")
    turns = turns.withColumn("conv_id", F.col("conv_id").cast(kind))
    back = chat_format.read_back(chat_format.format_conversations(turns, scratch_path(spark, "chat")))
    want = hashlib.sha256(f"user\n{'a' * 300_000}\nassistant\n\n".encode()).hexdigest()
    assert [(str(r["tree"]), r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in back.collect()] == [("1", 2, want, 0)]
    assert chat_format.read_back(chat_format.format_conversations(turns.where("false"), scratch_path(spark, "chat"))).count() == 0
    texts = spark.createDataFrame([(3, "one two three four five six seven eight nine"), (4, "other")], "doc_id long, text string")
    texts = texts.withColumn("doc_id", F.col("doc_id").cast(kind))
    found = decontamination.contaminated(texts, texts.where("text <> 'other'").withColumnRenamed("doc_id", "item_id"))
    assert [(str(r["doc_id"]), str(r["item_id"])) for r in found.select("doc_id", "item_id").collect()] == [("3", "3")]
    written = binary_output.round_trip(texts, queries.tokenizer_path("byte_bpe_50k.json"))
    assert written.schema["doc_id"].dataType == texts.schema["doc_id"].dataType
    assert sorted(str(r["doc_id"]) for r in written.collect()) == ["3", "4"]


def test_repeated_contents_are_encoded_once(spark):
    cache, model = scratch_path(spark, "cache"), queries.tokenizer_path("piece_bpe_32k.model")
    d = spark.range(100).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2).alias("text"))
    counted = token_counts.count_tokens(d, cache, model)
    library = token_counts.PieceCounter(model).library
    assert {(r["n_bytes"], r["n_tokens"]) for r in counted.collect()} == {(6, len(library.encode(f"text {i}"))) for i in (0, 1)}
    assert counted.count() == 100 and spark.read.parquet(cache).count() == 2


def test_token_counts_are_those_of_the_library(spark, docs):
    model = queries.tokenizer_path("piece_bpe_32k.model")
    library = token_counts.PieceCounter(model).library
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = token_counts.count_tokens(docs, scratch_path(spark, "cache"), model).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
