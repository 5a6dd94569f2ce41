"""Licences, personal data, URLs, toxicity and decontamination."""

import math
import random
import re
import zlib

import duckdb
import pytest
from places import SF

from trialframe.llm import decontaminate, licenses, pii, queries, toxicity, urls


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


# -- op1 ----------------------------------------------------------------------------------------
def test_license_own_and_inherited(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
    rows = [
        ("a/LICENSE", mit), ("a/x.py", "print(1)"), ("a/b/c/y.py", "y = 2"), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/z.py", "# Licensed under CC BY-NC 4.0.\n" + "z = 3\n" * 40),
        ("q/r.txt", "no licence of its own here at all"), (None, "text"), ("top.txt", None), ("a/w.txt", "a license is a thing that people talk about at great length without stating one for the file"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id int, path string, text string")
    out = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [out[i].license for i in range(9)] == ["MIT", "MIT", "Apache-2.0", "Apache-2.0", "CC-BY-NC-4.0", None, None, None, "MIT"]
    assert (out[2].inherited_from, out[1].inherited_from, out[8].own_license) == ("a/b", "a", None)


def test_license_odd(spark, odd, empty):
    assert licenses.license_scan(odd, path="path").count() == odd.count()
    assert licenses.license_scan(empty).count() == 0


def test_license_query(spark):
    got = {r.doc_id: r.own_license for r in queries.queries()["op1_license_scan"](spark, SF).collect()}
    said = {"MIT License": "MIT", "Apache License": "Apache-2.0", "CC BY-NC": "CC-BY-NC-4.0", "General Public": "GPL-3.0"}
    for i, text in table("documents", "doc_id, text"):
        assert got[i] == next((v for k, v in said.items() if k in text), None)


# -- op2 ----------------------------------------------------------------------------------------
def plain_spans(t):
    luhn = lambda s: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


@pytest.mark.parametrize("t", ["a@b.c@d.e", "x@y@z.com", "a@b", "@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.04", "+1 (743) 555-3824.", "4539 1488 0343 6467", "4539-1488-0343-6467-", "+12345678901+98765432109", "a..b@c..d", "é@x.de", "0001.2.3.4", ""])
def test_base_spans(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_base_spans_at_random():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("a1b2.@+- (9)34") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == plain_spans(t)


def test_patterns_discover(spark, odd, empty):
    rows = [(i, f"please call me at +1 (743) 555-{1000 + i} today, the weather in room number {i} is fine") for i in range(12)]
    rows += [(50, "please call me at 7435553824 today"), (51, "the room number 20240101 is fine")]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out[50].spans == "other:18:28" and out[51].spans == "" and out[3].n_phone == 1
    assert pii.redact(rows[0][1], out[0].spans) == rows[0][1].replace("+1 (743) 555-1000", "[PHONE]")
    got = pii.find(odd)
    assert got.count() == odd.count() and pii.find(empty).count() == 0
    assert {r.doc_id for r in got.where("spans <> ''").collect()} <= {11}


def plain_find(rows, rounds=3, least=0.8, support=5):
    """The added spans of each row, by dictionaries: patterns are the last one and two words before a place."""
    found = []
    for key, text in rows:
        base = plain_spans(text)
        places = [(s, e, True) for s, _, e in base]
        for m in re.finditer(r"(?<![^\s\"'=:(\[])[A-Za-z0-9](?:[A-Za-z0-9_./-]*[A-Za-z0-9])?", text):
            if len(m[0]) >= 6 and len(re.findall(r"\d", m[0])) >= 4 and not any(s < m.end() and m.start() < e for s, _, e in base):
                places.append((m.start(), m.end(), False))
        for s, e, seed in places:
            words = text[:s].lower().split()[-2:]
            found.append((key, s, e, seed, text[s:e].lower(), [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]))
    seeds: dict = {}
    edges = set()
    for _, _, _, seed, instance, ps in found:
        for p in ps:
            edges.add((p, instance))
            seeds[p, instance] = seeds.get((p, instance), False) or seed
    sure = {i for (_, i), v in seeds.items() if v}
    belief = {i: float(i in sure) for _, i in edges}
    by_pattern: dict = {}
    by_instance: dict = {}
    for p, i in edges:
        by_pattern.setdefault(p, []).append(i)
        by_instance.setdefault(i, []).append(p)
    strong = {p: sum(seeds[p, i] for i in own) for p, own in by_pattern.items()}
    for _ in range(rounds):
        score = {p: sum(belief[i] for i in own) / (len(own) + 1) for p, own in by_pattern.items()}
        belief = {i: 1.0 if i in sure else 1 - math.prod(1 - score[p] for p in own if strong[p] >= support) for i, own in by_instance.items()}
    good = {p for p, x in score.items() if x >= least and strong[p] >= support}
    more: dict = {key: set() for key, _ in rows}
    for key, s, e, seed, _, ps in found:
        if not seed and good & set(ps):
            more[key].add((s, e))
    return more


def test_pii_added_spans(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(("call", "mail", "us", "at", "room", "id", "write", "to", "number", "order"))
    data = lambda: rng.choice((f"+1 743 555 {rng.randint(1000, 9999)}", f"10.0.0.{rng.randint(1, 99)}", f"a{rng.randint(1, 99)}@b.org", f"X{rng.randint(10000, 99999)}", f"{rng.randint(100000, 999999)}", "w" * 200 + str(rng.randint(0, 3))))
    rows = [(i, " ".join(f"{word()} {'at' if rng.random() < 0.5 else word()} {data()}" for _ in range(rng.randint(1, 6)))) for i in range(150)]
    for own in (rows, [(i, t or "") for i, t in table("documents", "doc_id, text")]):
        got = {r.doc_id: {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("other")} for r in pii.find(spark.createDataFrame(own, "doc_id long, text string")).collect()}
        assert got == plain_find(own)
    assert any(x for x in plain_find(rows).values())


def test_long_words_before_an_entity():
    long = "x" * 300
    one, two, three = (pii.Before(t).patterns(len(t)) for t in (f"a {long}1 ", f"a {long}2 ", f"a {'y' + long}1 "))
    assert len({one[0], two[0], three[0]}) == 3 and one == pii.Before(f"b a {long}1  ").patterns(len(f"b a {long}1  "))
    text = "w=1234567," * 30_000
    assert len(pii.candidates(text, [])) == 30_000  # one word of 300,000 characters, read once


def test_pii_query(spark):
    got = {r.doc_id: r.spans for r in queries.queries()["op2_pii"](spark, SF).collect()}
    for i, text in table("documents", "doc_id, text"):
        assert [x for x in got[i].split(",") if not x.startswith("other")] == pii.joined(plain_spans(text)).split(",")


# -- op3 ----------------------------------------------------------------------------------------
def test_urls(spark):
    assert urls.split_url("HTTPS://A.Example.NET/En/x?y#z") == ("a.example.net", "/En/x")
    assert urls.split_url("https://h?x=/y") == ("h", "") and urls.split_url(None) == urls.split_url("no") == ("", "")
    rows = [(1, "http://a.net"), (2, "http://a.net/x"), (3, "http://x.example.net/en/1"), (4, "http://example.com/de/1"), (5, "http://notexample.com/de/1"), (6, "http://q.org/fr/"), (7, None), (8, "http://cheap-casino-pills.info/1"), (9, ""), (10, "http://thunder.example.com/en/4")]
    out = {r.page_id: (r.rule, r.verdict) for r in urls.url_filter(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert [out[i][0] for i in range(1, 11)] == [None, "net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None]
    assert (out[2][1], out[3][1], out[4][1], out[6][1], out[8][1], out[10][1]) == ("block", "allow", "block", "allow", "block", "allow")


def plain_url(url, model):
    """(host, path, rule, verdict) by regular expressions, a loop over all rules and the sum of the weights of all n-grams."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, action) for action, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    grams = {zlib.crc32((k + f"^{t}$"[i : i + n]).encode()) % urls.DIMENSIONS for k, t in (("h", host), ("p", path)) for n in (3, 4, 5) for i in range(len(t) + 3 - n)}
    z = sum(float(model[0][g]) for g in grams) / math.sqrt(max(1, len(grams))) + model[1]
    return host, path, None, "block" if z >= 0 else "allow"


def test_urls_match_brute_force(spark):
    model = urls.default_model()
    assert [tuple(r)[1:5] for r in sorted(queries.queries()["op3_url_filter"](spark, SF).collect())] == [plain_url(u, model) for _, u in sorted(table("pages", "page_id, url"))]


def test_urls_odd(spark):
    model = urls.default_model()
    rows = [(1, None), (1, None), (None, "http://a.net/"), (None, "http://a.net/"), (2, "HTTP://X" + "y" * 50_000 + "/" + "z" * 50_000), (3, "://"), (4, "http://é漢.org/fr/"), (5, "http://a.net:80/"), (6, "a://b://c/d"), (7, "http://.net/x")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id int, url string, host string, score string")
    out = [tuple(r)[:5] for r in urls.url_filter(docs).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(out, key=key) == sorted(((i, *plain_url(u, model)) for i, u in rows), key=key)
    assert urls.url_filter(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="host"):
        urls.url_filter(docs, keep=("page_id", "host"))


def test_url_model_on_unseen_hosts():
    """Each host is judged by a model that was trained without it and its paths, on other top domains; words are known from other hosts."""
    rows = urls.labelled()
    assert len({urls.split_url(u)[0] for u, _ in rows}) == len(rows) > 400
    right = 0
    for f in range(10):
        model = urls.train([r for k, r in enumerate(rows) if k % 10 != f], rounds=300)
        right += sum((plain_url(re.sub(r"\.(test|example)/", r".zone/", u), model)[3] == "block") == bool(y) for k, (u, y) in enumerate(rows) if k % 10 == f)
    assert right >= 0.9 * len(rows)


def test_url_host_of_many_parts():
    """A rule is looked up once a length of rules' hosts, however many dots a host has."""
    import time

    start = time.time()
    assert urls.rule_for("a." * 100_000 + "net", "/x", {"net": [("/", "block")]}, [3]) == ("net/", "block") and time.time() - start < 1


# -- op5 ----------------------------------------------------------------------------------------
def test_toxicity_learns_sentences(spark, odd, empty):
    words = ["vile", "nasty"]
    rows = [(f"A fine day number {i}. {'You are so ' + words[i % 2] + '. ' if i % 3 == 0 else ''}The sun is out.", int(i % 3 == 0)) for i in range(90)]
    model = toxicity.fit(rows)
    assert all((model.score(t)[0] >= 0.5) == bool(y) for t, y in rows)
    text = "The sun is out. How nasty you are. A fine day."
    assert [text[s:e] for s, e, _ in model.score(text)[2]] == ["How nasty you are."]
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.fit([]).score("x") == (0.0, 1, []) and toxicity.fit([("a", 1)]).score("a")[0] == 0.0
    for t in ("", None, "x"):
        assert 0 <= model.score(t or "")[0] <= 1


def test_toxicity_query(spark):
    out = queries.queries()["op5_toxicity"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in out} == {i for i, in table("documents", "doc_id")} and len(out) == len({r.doc_id for r in out})


def plain_toxicity(model, text):
    """Noisy-or over the sentences, with the features of each found by the plain function."""
    clean = 1.0
    for start, end in toxicity.sentences(text):
        z = model.bias + sum(model.weights.get(f, 0.0) for f in set(toxicity.features(text[start:end])))
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_held_out_accuracy(spark):
    """Through the very model that the query trains, on the fifth that it never saw; some of the toxic labels stand on texts without any cue."""
    from trialframe.llm.common import table as read

    big = SF.replace("sf0.001", "sf0.1")
    model = toxicity.train(read(spark, big, "documents"), read(spark, big, "labels"))
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), toxic FROM '{big}/documents.parquet' JOIN '{big}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    part = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    held = [(model.score(t)[0] >= 0.5, y) for i, t, y in rows if part(i)]
    assert sum(p and not y for p, y in held) <= 0.01 * sum(not y for _, y in held)
    assert sum(p and y for p, y in held) >= 0.9 * sum(y for _, y in held)
    for _, t, _ in rows[:300]:
        assert abs(model.score(t)[0] - plain_toxicity(model, t)) < 1e-9


def test_toxicity_trains_alike_on_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"A day {i}. {'You vile thing. ' if i % 2 else ''}Sun.") for i in range(40)] + [(i, "z other text under the same id") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = toxicity.train(docs, labels), toxicity.train(docs.orderBy(F.desc("text")).repartition(5), labels)
    assert one.weights == two.weights and one.bias == two.bias
    assert toxicity.train(docs, labels, characters=0).weights == {} == toxicity.train(docs.where("false"), labels).weights


# -- op7 ----------------------------------------------------------------------------------------
def plain_leaks(docs, items, least=13, score=10):
    tok = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    found, held = set(), {k: tok(t) for k, t in items}
    for i, t in docs:
        w = tok(t)
        for k, it in held.items():
            if len(it) < decontaminate.SPAN or not set(w) & set(it):
                continue
            for off in range(-len(it) + 1, len(w)):
                best = s = m = hits = 0
                for q in range(max(0, -off), min(len(it), len(w) - off)):
                    if s <= 0:
                        s = m = 0
                    same = w[q + off] == it[q]
                    s, m = s + (1 if same else -2), m + same
                    if s > best:
                        best, hits = s, m
                if best >= score and hits >= least:
                    found.add((i, k))
                    break
    return found


def test_leaks_tolerate_substitutions(spark, odd, empty):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    changed = " ".join("zzz" if i in (7, 15, 24) else w for i, w in enumerate(words))
    rows = [(1, f"before {item} after"), (2, f"so {changed}, then"), (3, " ".join(words[:9])), (4, None), (5, " ".join(words[5:25]).upper()), (1, f"before {item} after"), (6, " ".join(reversed(words))), (7, "a b " * 20_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    items = spark.createDataFrame([(9, item), (10, "too short"), (11, None), (9, item)], "item_id int, text string")
    out = {(r.doc_id, r.item_id): r.matches for r in decontaminate.leaks(docs, items).collect()}
    assert out == {(1, 9): 40, (2, 9): 37, (5, 9): 20, (7, 9): 40}
    assert decontaminate.leaks(empty, items).count() == decontaminate.leaks(docs, items.where("false")).count() == 0
    assert decontaminate.leaks(odd, items).count() == 0


def test_leaks_query(spark):
    docs, items = table("documents", "doc_id, text"), table("benchmark", "item_id, text")
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op7_decontaminate"](spark, SF).collect()}
    short = [(i, t) for i, t in docs if len(t) < 6000 or (i, 0) in got]
    want = plain_leaks(short, items)
    assert {x for x in got if x[0] in dict(short)} == want and want


def test_leaks_of_short_items(spark):
    word = lambda i, k: f"i{i}w{k}"
    sizes = {n: [word(n, k) for k in range(n)] for n in (1, 2, 3, 5, 11, 12, 13, 14, 15, 18)}
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in sizes.items()], "item_id int, text string")
    rows, want = [], set()
    for n, w in sizes.items():
        ways = [()] + [(k,) for k in range(n)] + [(a, b) for a in range(n) for b in range(a)]
        if n >= 15:
            ways += [(a, b, c) for a in range(n) for b in range(a) for c in range(b)]
        for gone in ways:
            rows.append((len(rows), "so " + " ".join("zzz" if k in gone else x for k, x in enumerate(w)) + " then"))
            if len(gone) <= (n // 5 if n >= 12 else 0):
                want.add((len(rows) - 1, n))
    rows += [(-1, " ".join(sizes[15][3:])), (-2, " ".join(sizes[15][:11])), (-3, " ".join(sizes[11][1:])), (-4, None)]
    want.add((-1, 15))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == want


def test_leaks_with_many_replaced_words(spark):
    rng = random.Random(5)
    item = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join("zzz" if k in gone else w for k, w in enumerate(item))) for i in range(400) for gone in [set(rng.sample(range(30), 6))]]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id int, text string")).collect()}
    assert got == {(i, 0) for i in range(400)}


def test_leaks_count_long_passages(spark):
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(1, "so it goes: " + " ".join(words)), (2, " ".join(words[40:290]))], "doc_id int, text string")
    items = spark.createDataFrame([(0, " ".join(words))], "item_id int, text string")
    assert {tuple(r) for r in decontaminate.leaks(docs, items).collect()} == {(1, 0, 300, 3, 302), (2, 0, 250, 0, 249)}


def test_license_sentence_without_anchor_word(spark):
    """A sentence that reaches the least cosine counts, whether or not it has one of the words that most licences have."""
    t = "and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    df = spark.createDataFrame([(1, "a/x.txt", t), (2, "b/y.txt", "and in the with or of that"), (3, "c/z.txt", "nothing")], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.license_scan(df).collect()}
    assert got == {1: "BSD-3-Clause", 2: None, 3: None}
