"""Chat windows, media, HTML, packing, the Jaccard join and the pipeline."""

import hashlib
import html as H
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from places import SF

import corpus_pipeline
from trialframe.llm import chat, graph, jaccard, media, packing, queries
from trialframe.llm import html as page


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


# -- op4 ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("t", ["", "\\", "\\### User: x</turn>", "### Assistant: </turn>\n", "####</turn></turn>\\\\", "a\n</turn>\nb", "<//turn>", "é😀"])
def test_chat_round_trip(t):
    assert chat.unescape(chat.escape(t)) == t
    for role in ("user", "assistant", "system", "User", "odd: role", "", "\\"):
        text = chat.head(role) + chat.escape(t) + chat.END + chat.head("user") + "b" + chat.END
        assert [x[:2] for x in chat.parse(text)] == [(role, t), ("user", "b")]


def windows(spark, rows, **k):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.chat_windows(df, **k)


def test_chat_windows(spark):
    rng = random.Random(1)
    rows = []
    for c in range(20):
        if c % 2:
            rows.append((c, 0, "system", "be brief"))
        rows += [(c, t + 1, ("user", "assistant")[t % 2], "x" * rng.randint(0, 300)) for t in range(rng.randint(1, 30))]
    rows += [(None, 0, "user", None), (99, None, None, "y"), (98, 0, "assistant", "z" * 9000), (98, 0, "assistant", "z" * 9000), (97, 0, "system", "alone")]
    out = windows(spark, rows, budget=200, history=60)
    held: dict = {}
    for r in out.collect():
        turns = chat.parse(r.text)
        assert sum(chat.tokens(x, y) for x, y, *_ in turns) == r.n_tokens and (r.n_tokens <= 200 or (r.over_budget and len(turns) <= 2))
        own = held.setdefault(r.conv_id, [])
        if own and own[0][0] == "system":
            assert turns[0][:2] == own[0]
        fresh = [x[:2] for x in turns[r.n_context :]]
        if r.n_context:
            shown = [x[:2] for x in turns[: r.n_context]]
            past = shown[1:] if own[0][0] == "system" else shown
            assert own[len(own) - len(past) :] == past
        own += fresh
        assert [chat.unescape(r.text[s.start : s.end]) for s in r.loss] == [y for x, y in fresh if x == "assistant"]
    want: dict = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert held == want
    assert windows(spark, []).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.queries()["op4_chat_format"](spark, SF).collect()}
    convs: dict = {-7: [("user", p := "\\### Assistant: </turn> ok"), ("assistant", p)]}
    for c, _, r, t in sorted(table("conversations", "conv_id, turn, role, text")):
        convs.setdefault(c, []).append((r, t))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())


# -- op6 ----------------------------------------------------------------------------------------
def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing(spark):
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b" * 50)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIIIHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    files = {"image/png": png(), "image/gif": gif, "image/bmp": bmp, "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 100), "audio/wav": media.stored_as_wav(b"abcd"), "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF", "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x01\xff\x00\x02\xff\xd9", "video/mp4": b"\0\0\0\x0cftypisom\0\0\0\x0amdatxx"}
    for kind, b in files.items():
        assert media.sniff_bytes(b, "text/plain")[:2] == (kind, True), kind
        inner = [x for x in media.carve(b"BM junk GIF89a " + b + b" tail") if x[0] == kind]
        assert inner and inner[0][1:3] == (15, 15 + len(b)), kind
        assert not [x for x in media.carve(b[:-1]) if x[1] == 0 and x[2] >= len(b)]
    rows = spark.createDataFrame([(1, bytearray(png()), "image/gif"), (2, None, "a/b"), (3, bytearray(b""), None)], "k int, content binary, declared string")
    out = {r.k: (r.detected, r.corrected, r.n_bytes) for r in media.sniff(rows, keep=("k",)).collect()}
    assert out == {1: ("image/png", True, len(png())), 2: ("a/b", False, 0), 3: (None, False, 0)}


def crc(data, poly, bits):
    c = 0
    for x in data:
        c ^= x << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) & 1 else 0)) & (1 << bits) - 1
    return c


def ogg_page(flags, segments):
    head = b"OggS\0" + bytes([flags]) + struct.pack("<QII", 0, 7, 0)
    tail = bytes([len(segments)]) + bytes(map(len, segments)) + b"".join(segments)
    return head + struct.pack("<I", crc(head + bytes(4) + tail, 0x04C11DB7, 32)) + tail


def flac(frames):
    info = struct.pack(">HH", 16, 16) + bytes(6) + ((44100 << 44) | (15 << 36) | 16 * frames).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x60, 0x08, k, 15])  # 16 samples, mono, 16 bits
        frame = head + bytes([crc(head, 0x07, 8)]) + b"\0\x12\x34"  # a constant subframe
        out += frame + struct.pack(">H", crc(frame, 0x8005, 16))
    return out


def test_audio_validators():
    stream = ogg_page(2, [b"one", b"two"]) + ogg_page(4, [b"three"])
    assert [x for x in media.carve(b"xx" + stream + b"tail") if x[0] == "audio/ogg"][0] == ("audio/ogg", 2, 2 + len(stream), 2 + 29, 2 + len(stream))
    broken = bytearray(stream)
    broken[30] ^= 1
    assert not media.carve(bytes(broken))
    for n in (1, 3):
        f = flac(n)
        assert media.carve(b"ab" + f + b"tail that is no frame") == [("audio/flac", 2, 2 + len(f), 2 + 42, 2 + len(f))]
        assert not media.carve(f[:-1])


@pytest.mark.parametrize("kind", range(len(media.SIGNATURES)))
def test_magics_in_great_numbers_take_linear_time(kind):
    """A megabyte of each magic, bare, among text, and as a header that promises more."""
    import time

    magic, name, offset = media.SIGNATURES[kind]
    headers = {"video/mp4": b"\0\0\0\x08ftyp", "application/gzip": magic + b"\x08\0\0\0\0\0\0" + b"n", "application/pdf": b"startxref %PDF-1 ", "riff": b"RIFF\xff\xff\0\0WAVEdata\x02\0\0\0ab", "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab", "image/png": magic + b"\0\0\0\0IDAT\0\0\0\0", "audio/ogg": b"OggS\0\x02" + bytes(20) + b"\x01\x01a"}
    for unit in (bytes(offset) + magic, bytes(offset) + magic + b" abc ", headers.get(name, magic + bytes(26))):
        start = time.time()
        media.carve(unit * (1_000_000 // len(unit)) + b"\0")
        assert time.time() - start < 5, (name, unit)


def test_gzip_members():
    """Headers with names, comments, extra fields; a wrong checksum or length is no member."""
    import gzip
    import io

    out = io.BytesIO()
    with gzip.GzipFile("a name", "wb", fileobj=out, mtime=0) as f:
        f.write(b"text " * 100_000)
    named = out.getvalue()
    bare = gzip.compress(b"abc", mtime=0)
    extra = bare[:3] + b"\x16" + bare[4:10] + b"\x02\0xy" + b"note\0" + b"hc" + bare[10:]
    for member in (named, bare, extra):
        assert [x[:3] for x in media.carve(b"pre" + member + b"post")] == [("application/gzip", 3, 3 + len(member))]
        assert media.carve(member[:-8] + b"\0" * 4 + member[-4:]) == [] and media.carve(member[:-1] + b"\7") == [] and media.carve(member[:-9]) == []


def test_kept_columns_must_not_clash(spark):
    from trialframe.llm import decontaminate, licenses, pii

    df = spark.createDataFrame([(1, b"GIF", "x", "a/b", "MIT", 0.5, "t")], "doc_id long, content binary, declared string, path string, license string, cosine double, text string")
    for call in (lambda: media.sniff(df.withColumn("carved", df.path), keep=("carved",)), lambda: licenses.license_scan(df, keep=("doc_id", "license")), lambda: licenses.license_scan(df, keep=("path",)), lambda: pii.find(df.withColumn("spans", df.path), keep=("spans",)), lambda: decontaminate.leaks(df.withColumn("matches", df.path), df.withColumn("item_id", df.path), keep=("matches",))):
        with pytest.raises(ValueError, match="keep names"):
            call()
    assert media.sniff(df, keep=("doc_id", "path")).first().detected == "x" and licenses.license_scan(df).count() == 1


def test_chat_with_clashing_columns(spark, empty):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    more = rows.select("*", *(F.lit("clash").alias(c) for c in ("n_tokens", "n_context", "loss", "window", "over_budget")))
    assert [tuple(r) for r in chat.chat_windows(more).collect()] == [tuple(r) for r in chat.chat_windows(rows).collect()]
    assert chat.chat_windows(more.where("false")).count() == 0


def test_media_digest(spark, odd, empty):
    for r in media.media_digest(odd).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 and r.media_bytes == r.payload_bytes + 44
    assert media.media_digest(empty).count() == 0
    got = {r.doc_id: r for r in queries.queries()["op6_media_columns"](spark, SF).collect()}
    for i, t in table("documents", "doc_id, text"):
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[i].media_sha256 == hashlib.sha256(media.stored_as_wav(payload)).hexdigest()


# -- op8 ----------------------------------------------------------------------------------------
def text_of(source):
    return page.main_text(source, page.grow(page.LABELLED))[0]


def test_html_parts():
    shell = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies, do you agree to that?</div>%s<aside>Related words here</aside><div id=comments><p>First! A reader says many words about this article today.</p></div><form>Name <input></form><footer>&copy; me</footer></body></html>"
    assert text_of(shell % "<article><h1>Head &amp; line</h1><p>One  <b>two</b>\n three<br>four<p>five &lt;x&gt; &#233;</article>") == "Head & line\nOne two three four\nfive <x> é"
    assert text_of(shell % "<main><div class=ad>Buy now</div><p>Some <a href=y>linked</a> text that goes on for long enough</main>") == "Some linked text that goes on for long enough"
    assert text_of(None) == text_of("") == text_of("<nav>x</nav>") == text_of("<!-- x") == ""
    assert text_of("<article><p>cut &am</p><p>tail <b") == "cut &am\ntail"
    assert text_of("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_html_query(spark):
    got = {r.page_id: r for r in queries.queries()["op8_html_extract"](spark, SF).collect()}
    for i, source in table("pages", "page_id, html"):
        body = source[source.find("<article>") : source.find("</article>") if "</article>" in source else None]
        parts = [" ".join(H.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|article)>", body)]
        assert got[i].text == "\n".join(x for x in parts if x) and got[i].n_chars == len(got[i].text)


def test_html_odd(spark):
    page_of = "<nav>Menu words</nav><article><header><h1>The title</h1></header><p>A sentence that stands in the article.</p></article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", page_of), (None, "u", page_of), (3, "u", "<div>" * 20_000 + "deep words in a row" + "</div>" * 20_000), (4, "u", "<p>x" * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id int, url string, html string, text string, n_chars int")
    out = {r.page_id: r.text for r in page.extract(df).collect()}
    assert page.extract(df).count() == len(rows) and page.extract(df.where("false")).count() == 0
    assert out[1] == out[2] == "" and out[None] == "The title\nA sentence that stands in the article." and out[3] == "deep words in a row"
    with pytest.raises(ValueError, match="text"):
        page.extract(df, keep=("page_id", "text"))


def test_html_without_names():
    """Pages whose elements and classes say nothing: lengths and link densities alone still tell menus from text."""
    import collections

    kept = found = wanted = 0
    for _, source in table("pages", "page_id, html"):
        bare = re.sub(r"<(/?)(nav|footer|aside|header|article|main|form|section)\b", r"<\1div", source)
        bare = re.sub(r"\s(?:class|id|role)=\"?[^\">\s]*\"?", "", bare)
        want, got = (collections.Counter(text_of(x).split()) for x in (source, bare))
        kept, found, wanted = kept + sum((want & got).values()), found + sum(got.values()), wanted + sum(want.values())
    assert kept >= 0.93 * found and kept >= 0.99 * wanted


# -- op9 ----------------------------------------------------------------------------------------
def plain_best_fit(pieces, capacity):
    bins = []
    for k, (n, s, c) in enumerate(pieces):
        fits = [b for b in bins if b["room"] >= n and b["room"] > 0 and s not in b["s"] and (c < 0 or c not in b["c"])]
        b = min(fits, key=lambda b: (b["room"], b["id"])) if fits else None
        if b is None:
            b = {"room": capacity, "id": len(bins), "s": set(), "c": set(), "k": []}
            bins.append(b)
        b["room"] -= n
        b["s"].add(s)
        b["c"] |= {c} - {-1}
        b["k"].append(k)
    return [(b["room"], b["k"]) for b in bins]


def test_best_fit_is_tightest():
    rng = random.Random(2)
    for _ in range(60):
        pieces = [(rng.randint(0, 50), rng.choice((0, 0, 0, 1, 2, 3, 4)), rng.choice((-1, -1, 0, 1))) for _ in range(rng.randint(1, 80))]
        assert [x[:2] for x in packing.best_fit(pieces, 50)] == plain_best_fit(pieces, 50)


def check_bins(bins, docs, capacity, sources=None):
    """Every word in one bin; with ``sources`` (id to source), no source and no copies (but for case and white space) twice in a bin."""
    spent: dict = {}
    texts = {i: " ".join((t or "").lower().split()) for i, t in docs}
    for b in bins:
        if sources:
            assert len({sources[i] for i in b.doc_ids}) == len(b.doc_ids) == len({texts[i] for i in b.doc_ids})
        assert sum(b.lengths) == b.used == capacity - b.residual <= capacity and b.n_sources == len(b.doc_ids)
        for i, s, n in zip(b.doc_ids, b.starts, b.lengths, strict=True):
            spent.setdefault(i, []).append((s, n))
    want: dict = {}
    for i, t in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want.setdefault(i, []).extend((k, min(capacity, n - k)) for k in range(0, max(n, 1), capacity))
    assert {i: sorted(x) for i, x in spent.items()} == {i: sorted(x) for i, x in want.items()}


def test_packing(spark, odd, empty):
    check_bins(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()], 1024)
    assert packing.pack(empty).count() == 0
    check_bins(queries.queries()["op9_best_fit_packing"](spark, SF).collect(), table("documents", "doc_id, text"), 1024, dict(table("documents", "doc_id, source")))
    check_bins(packing.pack(odd, shard_rows=3, capacity=100).collect(), [(r.doc_id, r.text) for r in odd.collect()], 100)


def test_packing_of_repeated_rows(spark):
    """A third of all rows is one row: it is dealt to many shards, none of which is overfull, and each copy has a bin of its own."""
    from pyspark.sql import functions as F

    docs = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c").otherwise(F.concat_ws(" ", F.lit("w"), "id")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("source"))
    bins = packing.pack(docs, shard_rows=2048).select("shard", "doc_ids").collect()
    size: dict = {}
    for b in bins:
        assert b.doc_ids.count(0) <= 1
        size[b.shard] = size.get(b.shard, 0) + len(b.doc_ids)
    assert sum(size.values()) == 60_000 and max(size.values()) <= 3 * 2048


def test_packing_by_given_clusters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"word{i} more", f"s{i}", 5 if i < 4 else None) for i in range(8)], "doc_id long, text string, source string, class long")
    bins = packing.pack(docs, cluster=F.col("class")).collect()
    assert len(bins) == 4 and all(len({0, 1, 2, 3} & set(b.doc_ids)) <= 1 for b in bins)


# -- op10 ---------------------------------------------------------------------------------------
def plain_join(docs, percent=80):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(docs)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    up[find(a)] = find(b)
    groups: dict = {}
    for a in range(n):
        groups.setdefault(find(a), []).append(docs[a][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((docs[a][0] is not None, docs[a][0] or 0, len(sets[a]), least[find(a)] or -1, len(groups[find(a)]), sum(sets[a] == x for x in sets) if sets[a] else 1) for a in range(n))


def joined(df, **k):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id if r.component_id else -1, r.class_rows, r.n_copies) for r in jaccard.jaccard_join(df, **k).collect())


def near_copies(seed=4, n=70):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 5000))
    base = [[word() for _ in range(rng.choice((4, 6, 40, 150, 400)))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            w[rng.randrange(len(w))] = word()
        rows.append((i + 1, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    return rows


def test_join_matches_brute_force(spark):
    rows = near_copies()
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == plain_join(rows)


@pytest.mark.parametrize(("groups", "percent"), [(4096, 80), (2, 80), (4, 70)])
def test_join_in_parts(spark, monkeypatch, groups, percent):
    """Small parts; with few groups the bound lets pairs through that don't link, so that blocks are verified too."""
    monkeypatch.setattr(jaccard, "TILE_POINTS", 3)
    monkeypatch.setattr(jaccard, "FIRST_POINTS", 5)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "HUB_ROWS", 2)
    rows = near_copies(seed=8)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), groups=groups, percent=percent) == plain_join(rows, percent)


def test_join_through_common_passages(spark):
    """Chains of near copies around the limit, and texts that share most of a passage and don't link."""
    rng = random.Random(12)
    word = lambda: "w" + str(rng.randint(0, 90_000))
    passage = [word() for _ in range(60)]
    rows = [(1000 + i, " ".join([*(word() for _ in range(rng.randint(5, 60))), *passage])) for i in range(60)]
    w = [word() for _ in range(120)]
    for i in range(60):  # each differs from the last by one or two words
        for _ in range(rng.choice((1, 2))):
            w[rng.randrange(len(w))] = word()
        rows.append((i + 1, " ".join(w)))
    for groups in (8, 4096):
        assert joined(spark.createDataFrame(rows, "doc_id long, text string"), groups=groups) == plain_join(rows)


def test_slabs_lose_no_link():
    """Any two sets that link have a slab in common, leading for the smaller one, whatever the order."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(4, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.append(rng.permutation(a)[: len(a) - int(rng.integers(0, max(1, n // 4)))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)))
        a, b = sorted((a, b), key=len)
        both = len(np.intersect1d(a, b))
        if both == len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        counts = rng.integers(0, 9, 1 << jaccard.SLOT_BITS)
        (own, lead), (same, _) = (jaccard.slabs(x, counts, 80) for x in (a, b))
        assert set(own[:lead].tolist()) & set(same.tolist())


def test_forest_spans_what_the_bound_allows():
    rng = np.random.default_rng(9)
    for m in (2, 5, 16, 60, 200):
        rows = rng.integers(0, 3, (m, 8)).astype(np.int32)
        rows[: m // 2] = rows[0] + (rng.random((m // 2, 8)) < 0.1)
        sizes = rows.sum(axis=1).astype(np.int64) + 1
        labels = rng.integers(0, m, m)
        least = np.minimum(rows[:, None], rows[None]).sum(axis=2)
        allowed = (180 * least >= 80 * (sizes[:, None] + sizes[None])) & (80 * np.maximum(sizes[:, None], sizes[None]) <= 100 * np.minimum(sizes[:, None], sizes[None]))

        def classes(edges):
            up = {int(x): int(x) for x in labels}

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in edges:
                up[find(int(labels[a]))] = find(int(labels[b]))
            return [find(int(x)) for x in labels], len({find(int(x)) for x in labels})

        edges = jaccard.forest(sizes, rows, labels, 80)
        assert all(allowed[a, b] for a, b in edges)
        (got, count), (want, wanted) = classes(edges), classes(np.argwhere(allowed))
        assert count == wanted and len(set(zip(got, want, strict=True))) == count and len(edges) == len(set(labels.tolist())) - count


def test_join_odd(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert joined(odd) == plain_join(rows)
    assert jaccard.jaccard_join(empty).count() == 0


def test_join_query(spark):
    rows = table("documents", "doc_id, text")
    got = sorted((True, r.doc_id, r.n_shingles, r.component_id or -1, r.class_rows, r.n_copies) for r in queries.queries()["op10_jaccard_join"](spark, SF).collect())
    assert got == plain_join(rows)


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(7)
    known = jaccard._Hashes()
    base = [f"t{x}" for x in rng.integers(0, 900, 600)]
    texts = []
    for k in range(120):
        w = list(base)
        for p in rng.integers(0, 600, k // 4):
            w[p] = f"x{k}_{p}"
        texts.append(" ".join(w[: 600 - k]))
    sets = [jaccard.shingles(t, known) for t in texts]
    sizes, rows = np.array([len(s) for s in sets]), jaccard._coordinates([jaccard.count_vector(s) for s in sets])
    tree = jaccard.CountTree(sizes, rows, 80)
    for i in range(0, 120, 7):
        found = set(tree.order[tree.search(int(sizes[i]), rows[i])].tolist())
        assert {j for j in range(120) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))} <= found


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


# -- pipeline -----------------------------------------------------------------------------------
def test_pipeline(spark):
    from trialframe.llm import decontaminate, pii, toxicity
    from trialframe.llm.common import table as read

    docs = read(spark, SF, "documents").cache()
    model = toxicity.train(docs, read(spark, SF, "labels"))
    rows = [tuple(r) for r in docs.collect()]
    now, names = docs, docs.columns
    want = [r for r in rows if model.score(r[1])[0] < 0.5]
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal now
        now = stages[name](spark, now, SF).cache()
        assert now.columns == names
        return sorted(tuple(r) for r in now.collect())

    assert step("toxicity") == sorted(want)
    roots = {x[1]: x[3] for x in plain_join([(r[0], r[1]) for r in want])}
    want = [r for r in want if (roots[r[0]] if roots[r[0]] >= 0 else 0) == r[0]]
    assert step("near_copies") == sorted(want)
    gone = {r.doc_id for r in decontaminate.leaks(now, read(spark, SF, "benchmark")).collect()}
    want = [r for r in want if r[0] not in gone]
    assert step("decontamination") == sorted(want) and gone
    after = step("pii")
    spans = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(want, docs.schema)).collect()}
    assert after == sorted((r[0], t := pii.redact(r[1], spans[r[0]]), r[2], r[3], len(t) if spans[r[0]] else r[4]) for r in want)
    check_bins(stages["packing"](spark, now, SF).collect(), [(r[0], r[1]) for r in after], 1024)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_odd(spark, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    from pyspark.sql import functions as F

    odd = odd.select("*", *(F.lit("clash").alias(n) for n in ("__row", "__gone", "__id", "__hash", "__class", "__SPANS", "__more")))
    for docs in (odd, odd.where("false")):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        kept = sorted((r.doc_id or 0) for r in now.collect())
        assert kept == ([0, 1, 2, 3, 4, 5, 7, 9, 10, 11] if docs is odd else [])


def test_near_copies_go_by_row(spark):
    rng = random.Random(6)
    text = lambda n=60: " ".join("w" + str(rng.randint(0, 9000)) for _ in range(n))
    near = lambda t: t + " more"
    a, b, c, d, own, other = (text() for _ in range(6))
    rows = [
        (5, a), (None, near(a)), (None, own), (None, other),  # only the linked row without an id goes
        (3, b), (8, near(b)), (8, text()),  # one of the two texts under id 8 is a copy
        (None, c), (None, near(c)), (9, d), (9, near(d)),  # near copies without id, and under one id
        (None, ""), (None, ""), (None, None), (7, ""), (6, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] or "")
    one_of = [t for t in got if t[1] in (c, near(c), d, near(d))]
    assert sorted((t[0] or 0) for t in one_of) == [0, 9]
    rest = sorted(((i, t or "") for i, t in got if (i, t) not in one_of), key=key)
    assert rest == sorted([(5, a), (None, own), (None, other), (3, b), rows[6], (None, ""), (7, ""), (6, "")], key=key)
