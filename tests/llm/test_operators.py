"""Each operator against plain Python on a small table with awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import llm_brute as brute
from rowmill.llm.decontaminate import FMIndex, contamination
from rowmill.llm.html_extract import extract, main_text
from rowmill.llm.line_dedup import dedup_lines
from rowmill.llm.minhash_dedup import near_duplicates
from rowmill.llm.packing import pack
from rowmill.llm.quotes import link_quotes
from rowmill.llm.spotsigs import edited, likeness, signature_sets, spot_fingerprints
from rowmill.llm.substring_dedup import COVER, PERIOD, remove_repeats
from rowmill.llm.text import CHUNK_BYTES, NON_WHITE, Words, chunks
from rowmill.llm.token_files import TokenFile, read_tokens, write_tokens
from rowmill.llm.toxicity import toxicity

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, id string, row int, kept_text string"


def texts():
    g = random.Random(3)
    vocab = ["the", "of", "and", "Wort", "été", "x1", "rain", "field", "stone", "over", "blue", "Ñu", "end."]
    say = lambda n: " ".join(g.choice(vocab) + str(g.randrange(30)) for _ in range(n))
    line = "A line that very many documents Share, longer than forty"
    passage = say(30)
    base = say(120).split()
    out = [None, "", " ", "\n\n", "one", "two words", say(4), say(5), say(12), say(13), say(14)]
    out += [f"{say(9)}\n {line.upper() if k % 2 else line}\t\n{say(6)}" for k in range(8)]
    out += [f"{say(7 + k)} {passage} {say(k)}" for k in range(6)]
    for k in range(30):                                   # near copies of one text
        w = list(base)
        w[g.randrange(len(w))] = f"edit{k}"
        out.append(" ".join(w))
    out += [" ".join(base)] * 9 + [passage, passage, "same\nsame", "same\nsame"]
    out += ["word " * 4000 + say(50), "z" * 5000, "日本語 テキスト " * 9, "tab\tand\x0bfeed\x0c here   nbsp"]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    random.Random(8).shuffle(t)
    return [(3 * k, x) for k, x in enumerate(t)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, f"e{i}", i % 7, "other") for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_spans_match_plain_split():
    t = [x for x in texts()] + ["x" * 300 + " y"]
    batch = pa.record_batch([pa.array(t)], names=["text"])
    got = []
    for _, buf, offs in chunks(batch, "text", 500):
        w = Words(buf, offs, NON_WHITE, False)
        raw = buf.tobytes()
        words = [raw[s:e] for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
        cut = w.first.tolist()
        got += [words[cut[d]:cut[d + 1]] for d in range(len(offs) - 1)]
    assert got == [(x or "").encode().split() for x in t]
    assert CHUNK_BYTES > 0


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_line_dedup(docs, rows, empty):
    out = dedup_lines(docs)
    got = sorted((r.row.doc_id, r.n_lines, r.n_dropped, brute.sha(r.kept_text)) for r in out.collect())
    assert got == sorted(brute.line_dedup(rows))
    assert sum(g[2] for g in got) >= 7
    assert out.first().row.kept_text == "other"
    assert dedup_lines(empty).count() == 0


def test_line_dedup_repeated_and_null_ids(spark):
    line = "this line is long enough to be looked at by it all"
    rows = [(None, line)] + [(k, line) for k in (1, 2, 3, 4)] + [(4, line + "\nx")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.row.doc_id is None, r.row.doc_id or 0, r.n_dropped) for r in got) == [
        (False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 0), (False, 4, 0), (True, 0, 1)]


def test_substring_dedup(docs, rows, empty):
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in remove_repeats(docs).collect())
    want = sorted(brute.repeats(rows))
    assert got == want
    assert sum(w[2] for w in want) > 1000
    assert remove_repeats(empty).count() == 0


def test_substring_dedup_repeated_and_null_ids(spark):
    t = " ".join(f"w{k}" for k in range(15))
    rows = [(None, t), (5, t), (5, t + " more"), (9, "pre " + t)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.row.doc_id or -1, r.n_words, r.n_removed) for r in got) == sorted(
        (i if i is not None else -1, n, d) for i, n, d, _ in brute.repeats(rows))


def test_near_duplicates(docs, rows, empty):
    got = sorted((r.id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
    assert got == brute.near(rows)
    assert near_duplicates(empty).count() == 0


def test_near_duplicate_chain_is_one_component(spark):
    """Neighbours are linked, the ends of the chain are not."""
    w = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(w[9 * k:9 * k + 130])) for k in range(25)]
    want = brute.near(rows)
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and len({c for _, _, c in want}) == 1


def test_boilerplate_is_no_link(spark):
    """A passage in all documents, and a real near copy among them."""
    g = random.Random(1)
    boiler = " ".join(f"b{k}" for k in range(60))
    own = [" ".join(f"o{g.randrange(10 ** 6)}" for _ in range(80)) for _ in range(300)]
    rows = [(k, f"{boiler} {x}") for k, x in enumerate(own)]
    rows.append((900, rows[7][1] + " tail"))
    got = {r.id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(900) == 7 and all(i == c for i, c in got.items())


def items(rows):
    some = [t for _, t in rows if t and len(t.split()) > 20][:6]
    return [(4, some[0]), (30, " ".join(some[1].split()[3:20])), (3, "two words"), (5, None), (6, " . "), (7, "one"), (7, "x1")]


def test_decontaminate(spark, docs, rows, empty):
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    out = contamination(docs, bench).collect()
    got = sorted((r.row.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in out)
    assert got == sorted(brute.contamination(rows, items(rows)))
    assert any(g[5] for g in got)
    for r in out:
        assert r.n_hit == sum(b - a for a, b in r.spans)
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontaminate_in_blocks(spark, docs, rows, monkeypatch):
    import rowmill.llm.decontaminate as D

    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    got = sorted((r.row.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated)
                 for r in contamination(docs, bench).collect())
    assert got == sorted(brute.contamination(rows, items(rows)))


def test_fm_index_finds_every_occurrence():
    g = np.random.default_rng(2)
    parts = [g.integers(1, 4, g.integers(1, 30)) for _ in range(40)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    offset = np.concatenate([np.append(np.arange(len(p)), 1) for p in parts])
    index = FMIndex(text, offset, 3)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            p = g.integers(1, 4, n)
            lo, hi = index.search(p[None, :], np.array([n]))
            got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert got == [i for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def test_packing(docs, rows, empty):
    t = library("byte_bpe_50k.json")
    out = pack(docs, tokenizers.path("byte_bpe_50k.json")).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    total = 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, brute.crc(ids[at:at + r.length]))
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids) and (len(ids) > 2048 or len(by[i]) == 1)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-total // 2048) + 1
    assert pack(empty, tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_files(spark, docs, rows, empty):
    path = tokenizers.path("word_bpe_49k.json")
    files = write_tokens(docs, path, end_id=2)
    got = sorted(tuple(r) for r in read_tokens(spark, files).collect())
    t, at, want = library("word_bpe_49k.json"), 0, []
    stream = []
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
        stream += ids
    assert got == want
    first = files.orderBy("part").first()
    ids, mask = TokenFile(first["name"])[0]
    n = min(first["n_tokens"], 2048)
    assert ids[:n].tolist() == stream[:n] and mask.sum() == n and not ids.flags.owndata
    assert read_tokens(spark, write_tokens(empty, path, end_id=2)).count() == 0


def test_spotsigs(docs, rows, empty):
    got = {r.id: r for r in spot_fingerprints(docs).collect()}
    order = sorted(rows)
    by_text = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        r, e = got[i], edited(t, nxt)
        a, b, c = signature_sets([t.encode(), e.encode(), nxt.encode()])
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(e))
        assert r.near_edited == likeness(a, b) and r.near_next == likeness(a, c)
        assert (r.fingerprint == r.edited_fingerprint) == (a.tolist() == b.tolist())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert spot_fingerprints(empty).count() == 0
    assert likeness(np.arange(3), np.arange(10), 0.5) == 0.0


def test_toxicity_learns_marked_words(spark):
    g = random.Random(4)
    say = lambda n: [f"w{g.randrange(60)}" for _ in range(n)]
    rows, labels = [], []
    for k in range(500):
        w, bad = say(g.randrange(5, 160)), k % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(g.randrange(len(w)), g.choice(["grobar", "vilx" + g.choice("abcdef")]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(1000, None), (1001, "")]
    labels += [(1002, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.row.doc_id: r.score for r in toxicity(docs, marks).collect()}
    held = [k for k, _ in labels if k is not None and k < 1000 and zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((got[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert right >= 0.97 * len(held) and len(held) > 60
    assert got[1000] == got[1001] < 0.5
    assert {r.score for r in toxicity(docs, marks.where("toxic = 0")).collect()} == {0.0}
    assert toxicity(docs.limit(0), marks).count() == 0


PAGE = ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>Menu</ul></nav>"
        "<div class='ad-3'>Buy</div><article><h1>Caf&eacute; &amp; co</h1><p><b>One <i>two</i>\n three<br>four<p>Five"
        "<div class='reader comments'><p>bad</div><!-- <p>gone</p> --><aside>side</aside>"
        "<ul><li>a<li>b</ul></article><form>f</form><footer>&copy; x</footer></body></html>")
MAIN = "Café & co\nOne two three four\nFive\na\nb"


def test_extract_cases():
    assert extract(PAGE, None) == MAIN
    assert extract(None, None) == extract("", "html/body") == extract("<p></p>", None) == ""
    assert extract("plain <b>text", None) == "plain text"
    assert extract("<div><p>a<p>b</div><p title='>'>c", None) == "a\nb\nc"


def test_main_text_uses_the_hosts_path(spark):
    layout = "<body><div class='lead'>{}</div><div class='story'><p>{}</p></div></body>"
    rows = [(k, f"http://H.example/{k}", layout.format("s" * 5, f"long text of page {k} " * 9)) for k in range(5)]
    rows += [(9, "http://h.example/9", layout.format("much longer than usual here " * 20, "short")),
             (10, None, PAGE), (11, "http://h.example/x", PAGE), (12, "bad url", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.row.page_id: r.main_text for r in main_text(pages).collect()}
    assert got[3] == ("long text of page 3 " * 9).strip()
    assert got[10] == got[11] == MAIN and got[12] == ""
    assert main_text(pages.limit(0)).count() == 0


def test_quote_links(spark):
    rows = [(1, 0, "u", "Hello there\nHow are  you?\nthird line"),
            (1, 1, "a", "> how are you?\nFine."),
            (1, 2, "u", ">> How are you?\n> Fine.\nGood to hear"),
            (1, 3, "a", "> third LINE\n> Hello there\n\nyes"),
            (1, 4, "u", "> nobody said this\nhm"),
            (2, 0, "u", "> Fine.\nother conversation"), (2, 1, None, None), (None, 5, "u", "> Fine."),
            (1, 5, "a", "> Good to hear\n"), (1, 5, "a", "> Good to hear\n")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.row.conv_id or 0, r.row.turn, r.quote_depth, r.parent_turn, r.path, r.own_text)
                  for r in link_quotes(m).collect()), key=repr)
    want = [(1, 0, 0, None, [0], "Hello there\nHow are  you?\nthird line"), (1, 1, 1, 0, [0, 1], "Fine."),
            (1, 2, 2, 1, [0, 1, 2], "Good to hear"), (1, 3, 1, 0, [0, 3], "yes"), (1, 4, 1, None, [4], "hm"),
            (1, 5, 1, 2, [0, 1, 2, 5], ""), (1, 5, 1, 2, [0, 1, 2, 5], ""),
            (2, 0, 1, None, [0], "other conversation"), (2, 1, 0, None, [1], None), (0, 5, 1, None, [5], "")]
    assert got == sorted(want, key=repr)
    assert link_quotes(m.limit(0)).count() == 0
