"""Tokens, packing, shards, languages, toxicity and pages against the libraries or by hand."""

import base64
import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from gumshoe.llm import bpe, html_text, language, toxicity
from gumshoe.llm.bpe import decode_documents, encode_documents, replay_merges
from gumshoe.llm.catalog import QUERIES
from gumshoe.llm.common import table
from gumshoe.llm.packing import Limits, Packer, pack_documents
from gumshoe.llm.sharding import _fill, _smallest, shard_documents
from gumshoe.llm.token_counts import count_tokens

ODD = [
    "", None, " ", "a  b", "\n\n x  y <|endoftext|> z", "<|endoftext|>", "x  y\x1c z'll 123  \t\n", "aaaaaaaaaaaaaaaa" * 300,
    "ß İ ΑΣ é 漢字 😀😀", "<|startoftext|>Hi<|endoftext|> THERE", "one two   three　", "They'll SAY it's 'S", "tie tie tie", "tie tie tie",
    "word " * 30_000,
]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES_JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS_JSON = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "own", i * 2) for i, t in enumerate(ODD)] + [(None, "no id", None, None), (12, "tie tie tie", "again", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def by_row(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_replay_equals_word_by_word():
    enc, ranks = encoding()
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeinrst"), rng.integers(1, 14))) for _ in range(3000)] + ["a" * 77, "é😀", "x"]
    for word, ids in zip(words, replay_merges([w.encode() for w in words], ranks)):
        assert ids == enc._core_bpe.encode_single_piece(word.encode())


def test_replay_in_waves_equals_one_by_one():
    """Words of all lengths up to and beyond the bound of waves, also for ranks no training would give."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc"), n)) for n in [*range(1, 71), *rng.integers(1, 12, 400)]] + ["a" * n for n in range(1, 70)]
    made = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 6))) for _ in range(80)})
    ranks = {bytes([i]): i for i in range(256)} | {made[i].encode(): 256 + n for n, i in enumerate(rng.permutation(len(made)))}

    def alone(word):
        parts = [bytes([x]) for x in word]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[x] for x in parts]

    assert replay_merges([t.encode() for t in texts], ranks) == [alone(t.encode()) for t in texts]
    assert replay_merges([b"a" * 65, b"", b"ab"], ranks) == [alone(b"a" * 65), [], alone(b"ab")] and replay_merges([], ranks) == []


def test_replay_of_many_words_takes_less_than_one_merge_at_a_time():
    _, ranks = encoding()
    rng = np.random.default_rng(2)
    words = sorted({bytes(x).decode("latin-1").encode() for x in (rng.choice(list(b" aeinorst\xe9"), rng.integers(6, 15)).astype(np.uint8) for _ in range(30_000))})
    merges = bpe.Merges(ranks)
    start = time.process_time()
    found = bpe.replay_bytes(words, merges)
    middle = time.process_time()
    expected = bpe.replay_long(words, ranks)
    end = time.process_time()
    assert found == [np.array(x, "<u4").tobytes() for x in expected]
    assert middle - start < 0.6 * (end - middle)


def test_encode_and_decode(odd, none):
    enc, _ = encoding()
    rows = decode_documents(encode_documents(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == len(ODD) + 2
    texts = {i: t for i, t in enumerate(ODD)} | {None: "no id"}
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(r.ids) // 4
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("frequent", [2, 100_000])
def test_token_counts(odd, none, frequent):
    library = Tokenizer.from_file(WORDS_JSON)
    texts = {i: t for i, t in enumerate(ODD)} | {None: "no id"}
    rows = count_tokens(odd, WORDS_JSON, frequent=frequent).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert count_tokens(none, WORDS_JSON).count() == 0


def test_packing(odd, none):
    library = Tokenizer.from_file(BYTES_JSON)
    rows = pack_documents(odd, BYTES_JSON, with_ids=True).collect()
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id not in (None, 12):
            documents.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    for i, text in enumerate(ODD):
        if i == 12:
            continue
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(documents[i], key=lambda r: r.start):
            part = ids[at : at + r.length].tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part)) and bytes(r.ids) == part
            at += r.length
        assert at == len(ids)
    assert sum(r.doc_id == 12 for r in rows) >= 2
    assert pack_documents(none, BYTES_JSON).count() == 0


def test_packing_of_instructions(spark, small_dir, none):
    """Answers of conversations after what was asked: prompts bear no loss, all three limits hold at once."""
    turns = spark.read.parquet(f"{small_dir}/conversations.parquet")
    asked = turns.filter("role <> 'assistant'").selectExpr("conv_id", "turn + 1 as turn", "text as prompt")
    rows = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").selectExpr("conv_id * 1000 + turn as doc_id", "prompt", "text", "1 as loss", "2 as ids")
    rows = rows.union(spark.createDataFrame([(-1, None, None, 1, 2), (-2, "word " * 900, "a", 1, 2), (-3, "a", "word " * 900, 1, 2), (-4, "", "", 1, 2)], rows.schema)).repartition(2)
    library = Tokenizer.from_file(BYTES_JSON)
    encode = lambda text: library.encode(text or "", add_special_tokens=False).ids
    whole = {r.doc_id: (encode(r.prompt), encode(r.text)) for r in rows.collect()}
    limits = Limits(256, 6, 100)
    sequences, documents = {}, {}
    for r in pack_documents(rows, BYTES_JSON, limits, prompt_col="prompt", with_ids=True).collect():
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        assert sum(r.length for r in pieces) <= 256 and len(pieces) <= 6 and sum(r.loss for r in pieces) <= 100
    assert max(sum(r.loss for r in pieces) for pieces in sequences.values()) == 100
    assert set(documents) == set(whole)
    for i, (before, after) in whole.items():
        pieces = sorted(documents[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == np.array([*before, *after, 0], "<u4").tobytes()
        assert sum(r.loss for r in pieces) == len(after) + 1
        assert all(r.loss == max(0, r.start + r.length - max(r.start, len(before))) for r in pieces)
    assert pack_documents(none, BYTES_JSON, prompt_col="text").columns[-1] == "loss"


@pytest.mark.parametrize("cut", [True, False])
def test_packer_keeps_all_limits(cut):
    rng = np.random.default_rng(3)
    limits = Limits(100, 4, 30)
    packer = Packer(limits, cut)
    examples = [(int(n), int(min(rng.integers(0, 25), n))) for n in rng.integers(1, 60 if not cut else 400, 6000)]
    sequences = [s for i, (n, loss) in enumerate(examples) for s in packer.add(i, n, loss)]
    sequences += list(packer.finish())
    placed = {}
    for sequence in sequences:
        tokens = sum(p.length for p in sequence)
        loss = sum(max(0, p.start + p.length - max(p.start, examples[p.example][0] - examples[p.example][1])) for p in sequence)
        assert tokens <= limits.tokens and len(sequence) <= limits.segments and loss <= limits.loss
        for p in sequence:
            placed.setdefault(p.example, []).append((p.start, p.length))
    for i, (n, _) in enumerate(examples):
        at = 0
        for start, length in sorted(placed[i]):
            assert start == at
            at += length
        assert at == n
        assert cut or len(placed[i]) == 1


def least_capacity(sizes, shards):
    """Smallest largest part by dynamic programming."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = sums.copy()
    for _ in range(shards - 1):
        best = np.array([min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))])
    return int(best[-1])


def test_binary_search_finds_the_optimum():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(1, 50, rng.integers(1, 40)).tolist()
        shards = int(rng.integers(1, 9))
        items = [(str(i), s, True) for i, s in enumerate(sizes)]
        capacity = _smallest(items, shards, False)
        assert capacity == least_capacity(sizes, shards)
        assert len(_fill(items, capacity, shards, False)) < shards


def test_shards(spark, odd, none):
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(rng.integers(0, 400)), "s") for i in range(3000)] + [(3000 + i, "hot " * 40, "s") for i in range(1500)] + [(9000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = shard_documents(docs, 8).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    texts = {i: t for i, t, _ in rows}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got.itertuples())
    got["text"] = [texts[i] or "" for i in got.doc_id]
    assert (got.groupby("text").shard.nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    groups = {}
    for r in got.itertuples():
        key = hashlib.md5(r.text.encode()).hexdigest()
        groups[key] = groups.get(key, 0) + r.size
    hot = max(groups, key=groups.get)
    rest = [groups[k] for k in sorted(groups) if k != hot]
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() == groups[hot] and loads.drop(loads.idxmax()).max() == least_capacity(rest, 7)
    assert shard_documents(none, 8).count() == 0
    assert shard_documents(odd, 8).count() == len(ODD) + 2


def test_language(spark, small_dir, odd, none):
    docs = table(spark, small_dir, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = QUERIES["op5_identify_language"](spark, small_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    model = language.fit_on(docs)
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit_on(none)).collect()} == {"und"}
    passed = language.determined_documents(odd, language.fit_on(none))
    assert 0 < passed.count() < odd.count()


def test_languages_of_many_letters(spark):
    """Two languages of 3,000 letters each, most of them shared, and one that has a single, very long text."""
    rng = np.random.default_rng(12)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    words = {n: ["".join(rng.choice(letters, 2)) for _ in range(1500)] for n in ("aa", "bb")}
    rows = [(i, "".join(rng.choice(words[n], 150)), n) for i, n in enumerate(["aa", "bb"] * 120)]
    rows.append((1000, "lorem ipsum dolor " * 4000, "cc"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_on(docs.filter("doc_id % 7 <> 3"))
    assert model.languages == ["aa", "bb", "cc"] and model.symbols.places == 3
    asked = docs.filter("doc_id % 7 = 3").collect()
    names, _ = language.Parser(model).predict([r.text for r in asked] + ["dolor lorem ipsum"])
    assert sum(n == r.lang for n, r in zip(names, asked)) >= 0.97 * len(asked) and names[-1] == "cc"
    table = model.symbols
    spelled = [language.encode(c, table).tobytes() for c in letters if (table.number[ord(c)] >= 0)]
    assert len(set(spelled)) == len(spelled) and all(len(x) == 3 for x in spelled)


def test_undetermined_documents_go(spark):
    """Documents of three languages stay; planted junk, garbled, mixed and unlearned-language texts go."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    pieces = {n: ["".join(rng.choice(letters, rng.integers(2, 5))) for _ in range(40)] for n in ("aa", "bb", "cc", "zz")}

    def prose(name, words=150):
        return " ".join("".join(rng.choice(pieces[name], rng.integers(1, 4))) for _ in range(words)).capitalize() + "."

    def garbled(text):
        return " ".join("".join(rng.permutation(list(w))) for w in text.split())

    rows = [(i, prose(n), n) for n in ("aa", "bb", "cc") for i in range({"aa": 0, "bb": 100, "cc": 200}[n], {"aa": 0, "bb": 100, "cc": 200}[n] + 80)]
    model = language.fit_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = [(1000 + i, prose(n, int(rng.integers(20, 300))), n) for i, n in enumerate(["aa", "bb", "cc"] * 30)]
    junk = [(2000 + i, "".join(rng.choice([*letters, " "], 400)), None) for i in range(30)]
    junk += [(3000 + i, garbled(prose("aa")), "aa") for i in range(30)] + [(4000 + i, prose("zz"), "zz") for i in range(30)]
    junk += [(5000 + i, prose("aa") + " " + prose("bb"), "aa") for i in range(30)] + [(6000, "123 !", "aa"), (6001, "漢字仮名交 " * 40, "aa"), (6002, None, "aa"), (6003, "", "aa")]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string").repartition(3)
    names = dict(zip([i for i, _, _ in clean], language.Parser(model).determined([t for _, t, _ in clean])))
    assert all(names[i] == n for i, _, n in clean)
    left = language.determined_documents(docs, model)
    assert {r.doc_id for r in left.collect()} == {i for i, _, _ in clean}
    assert {r.doc_id for r in language.determined_documents(docs, model, ["bb"]).collect()} == {i for i, _, n in clean if n == "bb"}


def test_cross_parsing_counts_longest_matches():
    model = language.fit({"a": ["abcabd"], "b": ["xyz"]})
    phrases, sizes, _ = language.Parser(model).phrases(["abdabc", "xyzxyz", ""])
    # "abd" + "abc" and its lane's end; "xyz" twice.
    assert phrases[0, 0] == 2 and phrases[1, 1] == 2 and sizes.tolist() == [6, 6, 0]


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(6)
    words = ["w" + str(i) for i in range(300)]
    sentence = lambda: " ".join(rng.choice(words, 8)) + "."
    rows, labels = [], []
    for i in range(600):
        parts = [sentence() for _ in range(6)]
        if i % 4 == 0:
            parts[int(rng.integers(6))] = " ".join(rng.choice(words, 5)) + " " + rng.choice(["vilefool", "vilethug", "dolt"]) + "."
        rows.append((i, " ".join(parts)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (10**6, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, marks.filter("doc_id is null or doc_id < 450"))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in range(450, 600)]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    for i in held:
        for span in got[i].offending:
            assert any(w in rows[i][1][span.start : span.end] for w in ("vile", "dolt"))
    scored = {r.doc_id: r.score for r in toxicity.score_documents(odd, model).collect()}
    assert scored[0] == scored[1] == 0 and all(0 <= s <= 1 for s in scored.values())
    assert toxicity.clean_documents(docs, model).count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.fit_on(none, marks).weights == {}


def test_toxicity_sample_passes_over_long_documents_and_has_rare_labels(spark, monkeypatch):
    rng = np.random.default_rng(10)
    words = ["w" + str(i) for i in range(200)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" vilefool." if i % 40 == 0 else ".")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 40 == 0)) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 200)
    toxicity.fit_on(docs, marks)
    assert len(seen[0][1]) <= 200 and sum(seen[0][1]) >= 15
    # The first of each label in the order of the hash is too long.
    order = [r.doc_id for r in marks.selectExpr("doc_id", "toxic", "xxhash64(doc_id) as h").orderBy("h").collect()]
    long = {next(i for i in order if i % 40), next(i for i in order if i % 40 == 0)}
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100_000)
    longer = spark.createDataFrame([(i, "toolong " * 20_000 if i in long else t) for i, t in rows], "doc_id long, text string")
    toxicity.fit_on(longer, marks)
    assert len(seen[1][1]) >= 150 and sum(seen[1][1]) >= 15 and not any("toolong" in t for t in seen[1][0])
    assert sum(map(len, seen[1][0])) <= 100_000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Some site</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="ad">Buy this thing now.</div><article><h1>A &amp; title</h1><p><b>First  line of
 text.<br><p>Second &eacute; line of the article &lt;here&gt;.</p><p style="display:none">Hidden words.</p></article>
<section class="comments"><div class="comment"><p>I do not agree at all.</p></div></section><aside><p>Elsewhere on this site.</p></aside>
<form><label>Name</label><input><textarea>x</textarea></form><footer>&copy; someone</footer></body></html>"""


def test_page_blocks():
    texts = [b.text for b in html_text.blocks_of(PAGE)]
    assert texts[:4] == ["Some site", "One", "Two", "Buy this thing now."]
    assert texts[4:7] == ["A & title", "First line of text.", "Second é line of the article <here>."]
    assert not any("Hidden" in t or "var" in t for t in texts)
    assert html_text.blocks_of("") == [] and [b.text for b in html_text.blocks_of("a < b")] == ["a < b"]


def test_page_blocks_are_hidden_by_their_own_attributes_only():
    shown = ['data-title="The hidden cost of rent"', 'class="a hidden b"', "title='display:none' id=x", 'style="color:red" aria-hidden="true"']
    gone = ["hidden", 'class="a" HIDDEN=""', 'style="color:red; display : none"', "style=display:none"]
    for attributes in shown:
        assert [b.text for b in html_text.blocks_of(f"<article {attributes}><p>Some text.</article>")] == ["Some text."]
    for attributes in gone:
        assert html_text.blocks_of(f"<article {attributes}><p>Some text.</article>") == []


def test_page_features_and_training_see_everything(spark, monkeypatch):
    long = html_text.blocks_of("<p>" + "a " * 64 + "</p>")[0], html_text.blocks_of("<p>" + "a " * 64 + "tail " * 64 + "</p>")[0]
    words = slice(html_text.PATH, html_text.PATH + html_text.WORDS)
    first, second = (html_text.Features()([b])[0, words] for b in long)
    assert (first != second).any()
    seen = []
    monkeypatch.setattr(html_text, "fit", lambda pages, labels: seen.extend(zip(map(len, pages), labels)))
    page = "<article>" + "<p>Words of it.</p>" * 150 + "</article><footer><p>The end.</p></footer>"
    html_text.fit_on(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    assert seen[0][0] == 151 and seen[0][1].tolist() == [1.0] * 150 + [0.0]


def test_pages(spark, small_dir):
    pages = table(spark, small_dir, "pages")
    model = html_text.fit_on(pages)
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (3, "u", "<p>" + "long words here. " * 20000)], "page_id long, url string, html string")
    got = html_text.extract_text(rows, model).collect()
    assert len(got) == 5
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in (1, None):
            assert r.text == "A & title\n\nFirst line of text.\n\nSecond é line of the article <here>."
    assert {r.text for r in got if r.page_id == 2} == {""}
    assert html_text.extract_text(rows.limit(0), model).count() == 0
    right = total = 0
    for r in html_text.extract_text(pages, model).collect():
        html = pages.filter(f"page_id = {r.page_id}").first().html if total < 12 else None
        if html is not None:
            blocks = html_text.blocks_of(html)
            right += r.text == "\n\n".join(b.text for b in blocks if "article" in b.path)
            total += 1
    assert right == total
