"""Corpus operators against brute-force versions on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest

from rowmill.llm import decontaminate, html_text, licenses, mixing, ngram_join, suffix_dedup, token_files, topk, toxicity, unit_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, size string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, rows, sources=("a", "b", None)):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", sources[n % len(sources)], len(t or ""), "x", "y", "z") for n, (i, t) in enumerate(rows)], SCHEMA)


def words(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, chains of them, shared passages, short, empty, null and repeated rows, and one long text."""
    r = random.Random(3)
    vocab = ["w%d" % r.randrange(10**6) for _ in range(900)] + ["ÄÖ", "été", "x y"]
    new = lambda n: [r.choice(vocab) for _ in range(n)]
    base, passage = new(90), new(60)
    texts = [" ".join(base)] * 4
    for n in (1, 2, 3, 4, 5, 6):
        t = list(base)
        for _ in range(n):
            t[r.randrange(len(t))] = "edit%d" % r.randrange(10**6)
        texts.append(" ".join(t))
    texts += [" ".join(new(30) + passage + new(40)) for _ in range(8)] + [" ".join(passage + new(3)) for _ in range(5)]
    texts += ["One Two\tthree\nFOUR", "one two three four", "one two three four five", "", None, " \n ", "x", "X", "ab " * 400, "ab " * 401]
    texts += [" ".join(new(80)) for _ in range(20)] + [" ".join(new(20000))] + ["Short line here.\n" + " ".join(new(20)) + ".\n" + " ".join(passage[:30]) + "." for _ in range(4)]
    out = [(i * 3, t) for i, t in enumerate(texts)]
    return out + [out[0], out[12], out[26]]


def test_ngram_join(spark, rows):
    rows = [x for n, x in enumerate(rows) if x not in rows[:n]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_classes(table(spark, rows)).collect()}
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {d: (len(sets[d]), find(d)) for d in ids}


def test_ngram_join_of_many_copies(spark):
    texts = [" ".join(f"t{j}" for j in range(60)) + (f" n{i}" if i % 2 else "") for i in range(300)]
    got = ngram_join.keep_one(table(spark, list(enumerate(texts)))).collect()
    assert [r.doc_id for r in got] == [0]


def test_suffix_dedup(spark, rows):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.drop_repeats(table(spark, rows)).collect())
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + 200] for _, t in raw for i in range(len(t) - 199))
    want = Counter()
    for d, t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[(d, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest())] += 1
    assert got == want


def test_crowded_anchors_take_the_counting_path(spark, rows, monkeypatch):
    plain = sorted(map(tuple, suffix_dedup.drop_repeats(table(spark, rows)).select("doc_id", "n_removed", "kept_sha256").collect()))
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    assert sorted(map(tuple, suffix_dedup.drop_repeats(table(spark, rows)).select("doc_id", "n_removed", "kept_sha256").collect())) == plain


def test_unit_dedup(spark, rows):
    """Against a plain version with its own splitting: paragraphs, lines, sentences and runs as lists of lower-cased words."""
    docs = sorted({d: t or "" for d, t in rows}.items())
    passage = "One. Two three four. Five six seven eight nine ten eleven twelve thirteen. Yes. No. Fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    extra = [(9000 + i, f"Own words of text {i} come first. {passage} Then others {i} follow.") for i in range(3)]
    extra += [(9100 + i, f"start{i} x\n\nA paragraph of two lines\nthat is repeated in other texts as well and has more than\ntwenty words, so that it is a region of its own\n\nend {i}") for i in range(3)]
    extra += [(9200, "Goes although it is short, as a sentence of ten words."), (9201, "Goes although it is short, as a sentence of ten words.")]
    extra += [(9300 + i, f"own {i}\n" + "\n".join(" ".join(f"w{n}x{j}" for j in range(n)) for n in range(2, 20)) + f"\nof\nlast {i}\nof") for i in range(4)]
    docs += extra

    def parts(t):
        out, at, sentences = [], 0, []
        for line in t.split("\n"):
            if line.strip():
                out.append((at, at + len(line)))
            sentences += [(at + m.start(), at + m.end()) for m in re.finditer(r"\S.*?(?:(?<=[.!?])(?=\s)|$)", line) if m[0]]
            at += len(line) + 1
        out += [m.span(1) for m in re.finditer(r"(?s)(?:\A|(?<=\n)[ \t]*\n\s*)((?:(?!\n[ \t]*\n).)+)", t) if "\n" in m[1]]
        word = lambda a, b: tuple(t[a:b].lower().split())
        sentences = [x for x in sentences if word(*x)]
        found = {(a, b, word(a, b)) for a, b in out} | {(a, b, word(a, b)) for a, b in sentences if len(word(a, b)) >= 8}
        for i in range(len(sentences)):
            for j in range(i + 1, len(sentences)):
                run = sentences[i : j + 1]
                sizes = [len(word(*x)) for x in run]
                if sizes[0] < 8 and sum(sizes) >= 8 > sum(sizes[:-1]) or sizes[-1] < 8 and sum(sizes) >= 8 > sum(sizes[1:]):
                    found.add((run[0][0], run[-1][1], ("run", *(word(*x) for x in run))))
        return sorted(found)

    docs = [(d, t) for d, t in docs if len(t) < 5000 and t.isascii()]
    seen, want = {}, {}
    for d, t in docs:
        for a, _, h in parts(t):
            seen.setdefault(h, (d, a))
    for d, t in docs:
        gone = [False] * len(t)
        for a, b, h in parts(t):
            if seen[h] != (d, a):
                gone[a:b] = [True] * (b - a)
        kept, i = "", 0
        while i < len(t):
            j = i
            while gone[i] and j < len(t) and (gone[j] or not t[j].strip() and any(gone[j:]) and not t[j : gone.index(True, j)].strip()):
                j += 1
            if j > i:
                i = j
            else:
                kept += t[i]
                i += 1
        want[d] = kept
    got = {r.doc_id: r.kept for r in unit_dedup.drop_repeated_units(table(spark, docs)).collect()}
    assert got == want
    assert got[9001].split() == "Own words of text 1 come first. Then others 1 follow.".split() and "paragraph" not in got[9102]
    assert got[9201] == "" and [got[9300 + i].split() for i in range(1, 4)] == [["own", f"{i}", "last", f"{i}"] for i in range(1, 4)]
    assert unit_dedup.drop_repeated_units(table(spark, docs), least_words=20).where("doc_id = 9201").first().kept == dict(docs)[9201]


def test_unit_dedup_without_spaces(spark):
    cjk = "这是一个重复的句子。没有空格的文字也是单元，所以每个字都算一个词。"
    got = {r.doc_id: r.kept for r in unit_dedup.drop_repeated_units(table(spark, [(3, cjk), (4, cjk), (None, "a b"), (None, "a b"), (5, None)])).collect()}
    assert got[3] == cjk and got[4] == "" and got[None] == "a b" and got[5] == ""  # equal rows are one document


def test_mixing(spark, rows):
    rows = [x for n, x in enumerate(rows) if x not in rows[:n]]
    docs = table(spark, rows)
    got = [r.asDict() for r in mixing.plan_mix(docs, mixing.Scratch(spark, "t")).collect()]
    size = {d: len(words(t)) for d, t in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size
    source = {d: ("a", "b", None)[n % 3] for n, (d, _) in enumerate(rows)}
    total = {s: sum(v for d, v in size.items() if source[d] == s) for s in ("a", "b", None)}
    share, open_, left = {}, dict(zip(("a", "b", None), (5, 2, 1))), sum(total.values())
    while True:  # fill by weight; what is above three times a source's size goes to the rest
        unit = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * unit > 3 * total[s]]
        if not full:
            share |= {s: w * unit for s, w in open_.items()}
            break
        for s in full:
            share[s] = 3 * total[s]
            left -= share[s]
            del open_[s]
    for s in total:
        part = [r for r in got if source[r["doc_id"]] == s]
        assert all(abs(r["target"] - share[s]) < 1e-6 and r["source_size"] == total[s] and r["taken"] <= 3 * r["size"] for r in part)
        assert share[s] - 1 < sum(r["taken"] for r in part) <= share[s] + 1e-6  # met to the word, by a text longer than it as well
    again = [r.asDict() for r in mixing.plan_mix(docs.repartition(7), mixing.Scratch(spark, "t")).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(again, key=key)
    mixed = mixing.mix(docs).collect()
    copies = Counter(r.doc_id for r in mixed)
    assert copies == {r["doc_id"]: -(-r["taken"] // r["size"]) for r in got if r["taken"]}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(words(r.text))
        assert dict(rows)[r.doc_id].startswith(r.text)
    assert taken == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


@pytest.mark.parametrize("hot, equal", [(None, True), (7, False)])
def test_mixing_splits_a_hot_id(spark, hot, equal):
    """A third of a source's rows share an id, or have none; the target ends within them."""
    text = lambda i: ("w" if equal else f"n{i}") + " w" * 9
    rows = [(hot, text(i), "b") for i in range(300)] + [(1000 + i, text(i), "b") for i in range(600)] + [(5000 + i, text(i), "a") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs, mixing.Scratch(spark, "t")).collect()
    b = [r for r in plan if (r.doc_id or 0) < 5000]
    assert len(plan) == len(rows) and 0 <= b[0].target - sum(r.taken for r in b) < 1
    want = Counter()
    for r in plan:
        want[r.doc_id] += -(-r.taken // r.size)
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == +want


def test_top_k(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], 0) for i in range(200)]
    rows += [(200 + i, rows[3][1], 0) for i in range(40)] + [(300, None, 0), (350, [None] * 6, 0), (400, [float("nan")] * 6, 0), (None, rows[4][1], 0), (450, [0.5] * 3, 0), (451, [0.25] * 3, 0), (500, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, df.where("vec_id % 50 = 0")).collect())
    import numpy as np

    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v and all(x is not None and x == x for x in v)]
    want = []
    for q, x in ok:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_licenses(spark):
    texts = ["Released under the MIT License. under the mit license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc by nc", None, "", "mit", "the mit licenseé under the mit licensee", "This work is licensed under the GNU General Public License, version 3."]
    texts.append("Permission is hereby granted, free of charge, to any person obtaining one copy of this software and its associated documentation files (the \"Software\"), to deal in the Software without restriction")
    got = {r.doc_id: r for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        assert (got[d].n_words, got[d].n_base, got[d].first_word, got[d].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert got[d].base_labels == ",".join(sorted({x for _, x in places})) and 0 <= got[d].score <= 1
    assert "gpl" in got[7].labels.split(",") and got[8].labels == "mit-notice"


def test_license_notices_against_plain_voting(spark):
    notice = licenses.NOTICES["gpl-notice"].split()
    bent = notice[:9] + ["really"] + notice[9:20] + notice[21:]
    texts = ["the gnu general " * 20, " ".join(notice), "a b " + " ".join(bent) + " c", " ".join(notice[:8]), " ".join(reversed(notice)), " ".join(notice) + " and " + " ".join(notice), "free software " * 300, " ".join(notice[14:] + notice[:14])]
    got = {r.doc_id: r for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for d, t in enumerate(texts):
        w, labels, best = t.split(), set(), 0.0
        for label, phrase in licenses.NOTICES.items():
            g = grams(phrase.split())
            votes = [(i - j, j, i) for i, x in enumerate(grams(w)) for j, y in enumerate(g) if x == y]
            lines, last = [], None
            for diag, j, i in sorted(votes):
                if last is None or diag - last > 4:
                    lines.append({})
                lines[-1][j] = min(i, lines[-1].get(j, i))
                last = diag
            for line in lines:
                n, top, low = 0, -1, min(line.values())
                for j in sorted(line):
                    n, top = (n + 1, line[j]) if line[j] > top else (n, top)
                low = next(line[j] for j in sorted(line))
                if n >= 0.6 * len(g) and n >= 0.4 * (top + 3 - low - 2):
                    labels.add(label)
                    best = max(best, n / len(g))
        assert (got[d].labels, round(got[d].score, 9)) == (",".join(sorted(labels)), round(best, 9))
    assert [got[d].labels for d in range(8)] == ["", "gpl-notice", "gpl-notice", "", "", "gpl-notice", "", ""]


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_hashes_hold_against_thue_morse_words(spark):
    """Strings that collide under every polynomial hash modulo 2**64."""
    from tokenizers import Tokenizer

    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    docs = [(1, one), (2, two), (3, one + " " + two), (4, "x " + one)]
    got = {r.doc_id: r.component_id for r in ngram_join.join_classes(table(spark, docs)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    lib = Tokenizer.from_file(token_files.tokenizer_path())
    crc = {r.doc_id: r.ids_crc32 for r in token_files.token_files(table(spark, docs)).collect()}
    for d, t in docs:
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        assert crc[d] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_files_order_rows_of_one_id(spark):
    """Null and repeated ids: starts follow one another and every run gives the same rows."""
    rows = [(None, f"null {i} " * (i % 5)) for i in range(40)] + [(3, f"text {i} " * (i % 7)) for i in range(40)] + [(3, "same")] * 5
    runs = [sorted(map(tuple, token_files.token_files(table(spark, rows).repartition(n)).select("start", "n_tokens", "ids_crc32", "doc_id").collect()), key=lambda r: r[:3]) for n in (2, 5)]
    assert runs[0] == runs[1] and all(a[0] + a[1] == b[0] for a, b in zip(runs[0], runs[0][1:]))


def test_token_files(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    extra = [(1, "a  b  c<|endoftext|>d"), (2, "tab\tand　wide  \n"), (4, "don't  stop\n\n\nnow '' "), (5, "’quoted’ \U0001f600 ab́")]
    want, start, lib = [], 0, Tokenizer.from_file(path)
    for d, t in sorted(rows + extra, key=lambda x: x[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    out = f"file://{tmp_path}/shards"
    token_files.write_tokens(table(spark, rows + extra), out, path, shard_ids=3000)
    got = sorted(map(tuple, token_files.read_digests(spark, out).collect()))
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want) and Counter(x[3] for x in got) == Counter(x[3] for x in want)
    assert token_files.tokens_of(spark, out, 4) == [lib.encode(extra[2][1], add_special_tokens=False).ids + [0]]


def test_new_pieces_go_to_the_tokenizer_as_they_stand(monkeypatch):
    """Pieces led by white space stand there one after another, without a special token after each; ids are those of the whole text."""
    import numpy as np

    class Spy:
        def __init__(self, lib):
            self.lib, self.texts = lib, []

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return self.lib.encode_batch_fast(texts, **options)

    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdeñé日'-.7") for _ in range(r.randint(1, 9))) for _ in range(300)) + r.choice(["", " ", "\n\n", " \t"]) for _ in range(20)]
    texts += ["", " ", "  a\n\n b", "x<|endoftext|> y", "wide\u3000space here"]
    data = [t.encode() for t in texts]
    for size in (token_files._TABLE, 16):  # a table so small that most pieces lose both their places
        monkeypatch.setattr(token_files, "_TABLE", size)
        enc = token_files.Encoder(token_files.tokenizer_path())
        lib, enc.lib = enc.lib, Spy(enc.lib)
        want = [lib.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        for _ in range(2):
            ids, lens = enc.encode(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum(list(map(len, data)))])
            assert ids.tolist() == sum(want, []) and lens.tolist() == list(map(len, want))
        led = [t for t in enc.lib.texts if t[:1].isspace()]
        assert sum(t.count(" ") for t in led) > 3000 and not any("<|endoftext|>" in t for t in led)


def test_grammar_round_trip():
    import numpy as np

    r = np.random.default_rng(2)
    for ids in (np.zeros(5000, np.uint32), r.integers(0, 30, 40000), np.array([], np.uint32), np.tile([1, 2, 3, 1, 2], 900)):
        seq, rules, lengths = token_files.compress(ids.astype(np.uint32), 100)
        assert (token_files.expand(seq, *token_files.expansions(rules, lengths, 100)) == ids).all()
        assert len(seq) < len(ids) or not len(ids)


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="page sidebar-left"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this page to do things that you may or may not want us to do.</div><article><header><h2>Head &amp; line</h2></header><p>First   paragraph&nbsp;with <b>bold<br>text</b> in it, long enough to count.<p>Of.
    <div class=ad>Buy this now, it is the best product that money can buy in this town.</div><p>Second &lt;paragraph&gt; &#233;t&eacute; follows here with more words.</p><aside>Related reading of many words that nobody wants to keep.</aside><p>End.</p>
    <form><p>Your name please and address</p></form></article><section id="comments"><p>I have an opinion about this article and it is long.</p></section><footer>&copy; all rights</footer>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst paragraph with bold text in it, long enough to count.\n\nOf.\n\nSecond <paragraph> été follows here with more words.\n\nEnd."
    plain = "<body><div class=menu>a b c</div><div><p>" + "Main text of the page goes on. " * 5 + "</p><p>More of it.</p></div><div class=footer>x</div></body>"
    assert html_text.main_text(plain) == ("Main text of the page goes on. " * 5).strip() + "\n\nMore of it."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""


def test_html_marks_are_whole_names():
    text = "This is a sentence of the article that is long enough to count."
    for around in ("div class='content has-sidebar'", "div id='post' class='with-comments'", "div class='no-sidebar'"):
        assert html_text.main_text(f"<body><{around}><p>{text}</p></div>") == text
    for part in ("<section id='discussion'><p>{}</p></section>", "<h2 id='related-work'>{}</h2>", "<h2 id='discussion'>{}</h2>", "<div class='legal-analysis'><p>{}</p></div>"):
        assert html_text.main_text("<article><p>" + text + "</p>" + part.format(text) + "</article>") == text + "\n\n" + text
    for part in ("<div class=share><a href=/>Share this article with everyone that you may know</a></div>", "<div class='ad-box'>" + text + "</div>", "<ul class=social><li>Mail<li>Post</ul>"):
        assert html_text.main_text("<article><p>" + text + "</p>" + part + "</article>") == text


def test_html_finds_the_article_without_names():
    """With every mark taken away, lengths alone tell the article from menu, advert and footer."""
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Part number {i}</a></li>" for i in range(8)) + "</ul></div>"
    body = [f"Paragraph {i} of the article has some words to say, and then it says a few more of them before it ends." for i in range(6)]
    page = f"<body>{menu}<div>Buy it now.</div><div><h1>Head line</h1>" + "".join(f"<p>{x}</p>" for x in body[:3]) + "<p>Short.</p>" + "".join(f"<p>{x}" for x in body[3:]) + "</div><div>(c) example</div></body>"
    assert html_text.main_text(page) == "\n\n".join(["Head line", *body[:3], "Short.", *body[3:]])
    for part in ("<div class='share-price'><p>{}</p></div>", "<section id='legal-history'><p>{}</p></section>"):
        assert html_text.main_text("<article><p>" + body[0] + "</p>" + part.format(body[1]) + "</article>") == body[0] + "\n\n" + body[1]


def test_html_keeps_the_ends_of_unlike_pages():
    """Closing sections, lists, tables and linked paragraphs, parts with everyday names, formulas; what stands outside goes."""
    text = ("Words of a paragraph go on for a while so that it counts. " * 3).strip()
    prose = "The evening offers soup and bread and many other good things to everybody who comes."
    for wrap in ("<div class='content'>{}</div>", "<div><div>{}</div></div>", "{}", "<section>{}</section>"):
        page = "<body><div><a href='/'>Home</a> <a href='/b'>More</a></div>" + wrap + "<div><p>Imprint 2020</p></div></body>"
        for end, want in (
            ("<section><p>Short end.</p></section>", "Short end."),
            ("<ul><li>one item<li>two</ul>", "one item\n\ntwo"),
            ("<table><tr><td>a cell</td><td>b</td></tr></table>", "a cell\n\nb"),
            ("<ol><li>first</li></ol><dl><dt>t</dt><dd>d</dd></dl>", "first\n\nt\n\nd"),
            ("<p><a href='x'>A whole paragraph that stands in one link at the end of it all.</a></p>", "A whole paragraph that stands in one link at the end of it all."),
        ):
            assert html_text.main_text(page.format(f"<p>{text}</p><p>{text}</p>{end}")) == f"{text}\n\n{text}\n\n{want}", (wrap, end)
    for part in ("<section class='menu'><p>{}</p></section>", "<div class='banner'><p>{}</p></div>", "<section id='widgets'><p>{}</p></section>", "<header><p>{}</p></header>"):
        assert html_text.main_text(f"<article><p>{text}</p>{part.format(prose)}</article>") == f"{text}\n\n{prose}"
    for part in ("<ul class='menu'><li><a>Home</a><li><a>About</a></ul>", "<div class='ad'><p>{}</p></div>", "<form><p>{}</p></form>", "<div class='comments'><p>{}</p></div>", "<aside>{}</aside>"):
        assert html_text.main_text(f"<article><p>{text}</p>{part.format(prose)}</article>") == text
    assert html_text.main_text(f"<article><p>{text}</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>") == f"{text}\n\nso x=1 holds"
    low = "<div><p>{0}</p>" + "<div class='ad'>buy</div>" * 4 + "<p>Low end.</p></div>"
    assert html_text.main_text("<body>" + low.format(text * 9) + "</body>").endswith("Low end.")
    deep = "<article>" + "<b>" * 3000 + text + "<p>next" + "</b>" * 3000 + "</article><p>after</p>"
    assert html_text.main_text(deep) == f"{text}\n\nnext"


def test_html_surge_and_dive_against_plain_windows():
    """Pages of one paragraph a line in one container: regions of windows by their definition."""
    r = random.Random(6)
    for _ in range(200):
        sizes = [r.choice([0, 0, 0, 5, 30, 200]) for _ in range(r.randint(1, 30))]
        page = "<body>" + "".join(f"<p>{'x' * n}</p>" if n else f"<p><a>{'link' * 9}</a></p>" for n in sizes) + "</body>"
        window = [sum(sizes[i : i + 3]) for i in range(len(sizes))]
        want, i = [], 0
        while i < len(sizes):
            j = i
            while j < len(sizes) and window[j]:
                j += 1
            if j > i and max(window[i:j]) >= 0.2 * max(window):
                inside = [k for k in range(i, min(len(sizes), j + 2)) if sizes[k]]
                want += ["x" * sizes[k] if sizes[k] else "link" * 9 for k in range(inside[0], inside[-1] + 1)]
            i = j + 2 if j > i else i + 1
        assert html_text.main_text(page) == "\n\n".join(want)


def test_html_broken_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for bad in ("<a href=\"x", "<!--", "<", "<div class='a", "</div>", "<b x=\"<"):
        html_text.main_text(bad * (3_000_000 // len(bad)))
    assert time.perf_counter() - began < 60


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>A short page.</p>", 3), (2, None, None, 4), (1, "u", "<p>A short page.</p>", 3), (3, "", "<p>" + "word " * 200_000, None)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "A short page.", 13), (1, "A short page.", 13), (2, "", 0), (3, ("word " * 200_000).strip(), 999_999)]


def test_decontaminate(spark):
    r = random.Random(8)
    vocab = ["v%d" % i for i in range(3000)] + ["the", "of"] * 200
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(12, 50))) for i in range(30)] + [(99, None), (98, "too short"), (97, text(150))]
    docs, want = [], set()
    for i in range(120):
        t = text(200)
        if i % 10 == 0:
            item, passage = r.choice(items[:30])
            w = passage.split()
            if i % 20 == 0:  # a paraphrase: some words replaced
                for j in range(0, len(w) - 4, 8):
                    w[j] = "other%d" % j
            t = text(r.randint(0, 90)) + " " + " ".join(w).upper() + ". " + text(80)
            want.add((i, item))
        docs.append((i, t))
    docs += [(500, None), (501, ""), (502, items[-1][1])]
    want.add((502, 97))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(table(spark, docs), bench).collect()}
    assert found == want
    assert {x.doc_id for x in decontaminate.drop_leaks(table(spark, docs), bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontaminate_finds_items_of_frequent_words(spark):
    r = random.Random(9)
    text = lambda n: " ".join("u%d" % r.randrange(5000) for _ in range(n))
    often, item = [f"f{j}" for j in range(8)], text(30)
    common = " ".join(r.choice(often) for _ in range(20))
    docs = [(i, text(60) + " " + " ".join(often) + " " + (item if i % 3 == 0 else text(30)) + " " + text(40)) for i in range(90)]
    docs += [(100, text(50) + " " + common + " " + text(50)), (101, common), (102, item), (103, "")]
    bench = spark.createDataFrame([(1, item), (2, common), (3, text(25))], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(table(spark, docs), bench).collect()}
    assert found == {(i, 1) for i in (*range(0, 90, 3), 102)} | {(100, 2), (101, 2)}


def _common(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_decontaminate_long_items(spark):
    """Items of several pieces: whole, without their answer, their preamble alone, and in every document."""
    r = random.Random(10)
    text = lambda n: " ".join("u%d" % r.randrange(9000) for _ in range(n))
    items = {i: text(n) for i, n in enumerate((65, 96, 97, 150, 500))}
    docs, want = [], set()
    for i, t in items.items():
        w = t.split()
        docs += [(10 * i, text(40) + " " + t + " " + text(30)), (10 * i + 1, text(9) + " " + " ".join(w[: len(w) - len(w) // 5])), (10 * i + 2, " ".join(w[:45]) + " " + text(50)), (10 * i + 3, " ".join(w[-64:]) if i > 2 else text(5))]
        want.add((10 * i, i))
    bench = spark.createDataFrame([*items.items(), *items.items()], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(table(spark, docs), bench).collect()} == want
    everywhere = [(i, text(30) + " " + items[1] + " " + text(30)) for i in range(40)]
    assert len({x.doc_id for x in decontaminate.leaks(table(spark, everywhere), bench).collect()}) == 40


@pytest.mark.parametrize("edits", [0.1, 0.2])
def test_decontaminate_recall(spark, edits):
    """Candidates against brute force: every pair whose common subsequence is long enough on the plain table."""
    r = random.Random(11)
    vocab = ["v%d" % i for i in range(2000)] + ["the", "of", "and"] * 150
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [text(r.randint(12, 60)) for _ in range(40)]
    docs = []
    for i in range(120):
        w = list(items[i % 40])
        for _ in range(int(edits * len(w))):
            j = r.randrange(len(w))
            w[j : j + r.randint(0, 1)] = ["x%d" % r.randrange(10**6)] if r.random() < 0.5 else []
        docs.append(text(r.randint(0, 70)) + w + text(60))
    want = set()
    for i, d in enumerate(docs):
        for j, w in enumerate(items):
            k = max(3, len(w) // 5)
            if i % 40 == j and any(_common(w, part) >= 0.7 * len(w) and _common(w[-k:], part) >= 0.5 * k for part in (d[s : s + 128] for s in range(0, len(d), 32))):
                want.add((i, j))
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(table(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), bench).collect()}
    assert len(found & want) >= 0.9 * len(want) > 60 and all(i % 40 == j for i, j in found)


def test_decontaminate_takes_bounded_memory():
    """Half a million short words of the benchmark in one run of texts take no more memory than long ones; sums are the plain ones."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    r, words = np.random.default_rng(4), np.array([chr(97 + i) for i in range(26)])
    texts = [" ".join(r.choice(words, 50_000)) for _ in range(10)] + [""]
    raw = [(i, " ".join(r.choice(words, 8)) + f" only item {i} has") for i in range(30)]
    items = decontaminate._pieces_of(raw)
    vocab = np.unique(np.concatenate([np.array(x.words, np.uint64) for x in items]))
    idf, omega = r.uniform(0.5, 2, len(vocab)), r.standard_normal((len(vocab), 80)).astype(np.float32)
    vectors = r.standard_normal((len(items), 64)).astype(np.float32)
    basis = np.linalg.qr(r.standard_normal((len(vocab), 64)))[0].astype(np.float32)[:, :64] if len(vocab) >= 64 else omega[:, :64]
    rest = (items, vectors, np.ones(len(items)), np.full(len(items), 1e9))
    batch = pa.RecordBatch.from_arrays([pa.array(range(11), pa.int64()), pa.array([b"k"] * 11), pa.array(texts)], names=["doc_id", "k", "text"])
    for step, shared in ((decontaminate._sketch, (vocab, idf, omega)), (decontaminate._confirmed, (vocab, idf, basis, *rest))):
        tracemalloc.start()
        list(step(SimpleNamespace(value=shared))(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 120e6, (step, peak)
    data = [t[:5000].encode() for t in texts]
    p = decontaminate._Passages(vocab, idf, *decontaminate.words_of(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum(list(map(len, data)))]))
    assert np.allclose(p.vectors(omega), p.sums(omega[p.term] * p.weight[:, None].astype(np.float32)), atol=1e-3)


def test_latent_space():
    import numpy as np

    r = np.random.default_rng(1)
    a = r.standard_normal((300, 12)) @ np.diag(2.0 ** -np.arange(12)) @ r.standard_normal((12, 80))
    omega = r.standard_normal((80, 24))
    v, s = decontaminate.latent_space(a.T @ (a @ omega), omega, 8)
    true = np.linalg.svd(a)
    assert np.allclose(s, true[1][:8], rtol=1e-3) and np.allclose(np.abs(np.sum(v * true[2][:8].T, axis=0)), 1, atol=1e-2)


def test_toxicity(spark):
    r = random.Random(4)
    vocab = ["w%d" % i for i in range(400)]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for j in range(5):
                w[r.randrange(60)] = r.choice(["grumbler%d" % j, "idiot", "vexlicht" + r.choice("abcdef")])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    docs += [(1000, None), (1001, ""), (None, "idiot"), docs[0]]
    labels += [(5000, 1, 1), (0, 0, 1), (7, None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(table(spark, docs), lab).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 600]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)
    none = toxicity.toxicity(table(spark, docs), lab.limit(0)).collect()
    assert len(none) == len(docs)


def test_empty_tables(spark):
    empty = table(spark, [(1, "x")]).limit(0)
    bench = spark.createDataFrame([(1, "some words that make up an item of the benchmark")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (ngram_join.join_classes(empty), ngram_join.keep_one(empty), suffix_dedup.drop_repeats(empty), unit_dedup.drop_repeated_units(empty), mixing.mix(empty), licenses.scan(empty), token_files.token_files(empty), decontaminate.leaks(empty, bench), decontaminate.leaks(table(spark, [(1, "x")]), bench.limit(0)), toxicity.drop_toxic(empty, labels), topk.top_k(vectors, vectors), html_text.extract(pages)):
        assert df.count() == 0
