"""Operators of the subpackage against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import bpe, chat, decontaminate, htmltext, licenses, neardup, quality, secrets, urls, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = [None, "", " ", "a", "é" * 50, "x " * 3000, "x " * 3000, "\n\n\n", "<|endoftext|> Hi", "password = abcdefghijklmnop"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "w") for i, t in enumerate(EDGE)] + [(3, "a", "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, spans string")


# Secrets

BASE = [
    ("assign", re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 12),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute_secrets(data):
    found = [(m.start(), m.end(), k) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(data) if ok(m)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_secret_automaton_finds_what_the_regexes_find():
    scanner, rng = secrets._scanner(secrets.RULES), random.Random(5)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4", "deadbeef", "0123456789", "é", ".", "-", "eyJ", "ghp_", "a" * 12]
    for _ in range(3000):
        data = "".join(rng.choices(parts, k=rng.randint(0, 16))).encode()
        assert [s for s in scanner.spans(data) if s[2] < 3] == brute_secrets(data), data


def test_secret_extra_kinds_and_code_points():
    scanner = secrets._scanner(secrets.RULES)
    text = "é ghp_" + "a1B2" * 10 + " -----BEGIN RSA PRIVATE KEY-----"
    kinds = [(secrets.RULES[k].kind, text[s:e]) for s, e, k in scanner.points(text.encode())]
    assert kinds == [("github", "ghp_" + "a1B2" * 10), ("pem", "-----BEGIN RSA PRIVATE KEY-----")]


def test_secret_digest_and_redaction(spark, edge, none, docs):
    rows = {r.doc_id: r for r in secrets.digest(docs).collect()}
    for d, text in docs.collect():
        data = (text or "").encode()
        at = lambda n, data=data: len(data[:n].decode())
        spans = [(BASE[k][0], at(s), at(e)) for s, e, k in brute_secrets(data)]
        assert [getattr(rows[d], f"n_{kind}") for kind, _, _ in BASE] == [sum(k == kind for k, _, _ in spans) for kind, _, _ in BASE]
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert rows[d].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        kinds = {kind for kind, _, _ in BASE}
        assert [x for x in rows[d].spans.split(",") if x.split(":")[0] in kinds] == told.split(",") * bool(told) or not told
    assert secrets.digest(edge).count() == edge.count() and secrets.digest(none).count() == 0
    cleaned = secrets.redact(edge)
    assert cleaned.columns == edge.columns
    assert "abcdefghijklmnop" not in {r.doc_id: r.text for r in cleaned.collect()}[9]


def test_private_keys_go_whole(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choices("ABCabc019+/", k=64)) for _ in range(5)] + ["qR7+/kLmNo=="]
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    info = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    body = "\n".join(lines)
    texts = {
        f"é a\n{head}\n{body}\n{foot}\nafter it": "é a\n[secret]\nafter it",
        f"a {head}\r\n{info}{body}\r\n{foot} b": "a [secret] b",
        f"{head}\n{body}\nand more text": "[secret]\nand more text",
        f"{head}\n{info}{body}": "[secret]",
        f"{head}\n{body[:-3]}": "[secret]",
        f"{head} {' '.join(lines)} and more text": "[secret] and more text",
        f'"{head}\\n{body.replace(chr(10), chr(92) + "n")}\\n{foot}\\n", b': '"[secret]\\n", b',
        f"{head}\n{body}\n{head}\n{body}\n{foot} é {head}\n{body}": "[secret]\n[secret] é [secret]",
        f"{head}\n{body}\n-----BEGIN CERTIFICATE-----\nMIIB\n-----END CERTIFICATE-----": "[secret]\n-----BEGIN CERTIFICATE-----\nMIIB\n-----END CERTIFICATE-----",
        f"the line {head} opens a key": "the line [secret] opens a key",
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cleaned = {r.doc_id: r.text for r in secrets.redact(rows).collect()}
    for i, (text, expected) in enumerate(texts.items()):
        assert cleaned[i] == expected, text
        assert not any(line in cleaned[i] for line in lines)
    first = next(iter(texts))
    kinds = [(secrets.RULES[k].kind, first[s:e]) for s, e, k in secrets._scanner(secrets.RULES).points(first.encode())]
    assert ("pem", f"{head}\n{body}\n{foot}") in kinds


# Quality


def test_windows_that_share_a_hash():
    plain = [f"w{i}".encode() for i in range(30)]
    assert quality.repeated_words(np.zeros(30, np.uint64), plain) == 0
    assert quality.repeated_words(np.zeros(38, np.uint64), plain + plain[5:13]) == 16
    assert quality.repeated_words(np.zeros(5, np.uint64), plain[:5]) == 0


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)]


def test_quality_statistics(docs):
    for text in [*EDGE, *(r.text for r in docs.collect())]:
        assert quality.statistics(text)[0] == brute_statistics(text)


def test_forest_learns_and_keeps_its_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    good = x[:, 2] + 0.3 * x[:, 0] < 0.7
    forest = quality.fit(x[:2000], good[:2000])
    assert (forest.keeps(x[2000:]) == good[2000:]).mean() > 0.95
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            at = np.tile(x[:200], (1, 1))
            more = at.copy()
            more[:, f] += 0.3
            assert (sign * (forest.probability(more) - forest.probability(at)) >= -1e-12).all()
    assert quality.fit(x, np.ones(3000, bool)) is None


def walked(forest, x):
    """The probability of one row, node by node and tree by tree."""
    total = forest.bias
    inner = forest.feature.shape[1]
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
        at = 0
        while at < inner:
            at = 2 * at + (2 if x[feature[at]] > cut[at] else 1)
        total += leaf[at - inner]
    return 1 / (1 + np.exp(-total))


def test_quality_verdicts_against_tree_walks(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.train(docs, labels)
    assert forest is not None
    rows = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for d, text in docs.collect():
        n, _, _, _, repeats = brute_statistics(text)
        failed = n < 20 or 100 * repeats > 30 * n
        p = walked(forest, quality.statistics(text)[1])
        assert rows[d].base_failed == failed and abs(rows[d].probability - p) < 1e-9
        assert rows[d].kept == (not failed and p >= forest.threshold)


def test_quality_judge_edges(spark, sf, edge, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in quality.judge(edge, labels).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept
    assert rows[5].n_words == 3000 and rows[5].base_failed
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(edge, labels.limit(0)).count() == edge.count()
    assert quality.keep_good(edge, labels).columns == edge.columns


# Decontamination


def test_decontamination_against_brute_force(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, WORD.findall(low(r.text))) for r in bench.collect()]
    rows = {r.doc_id: r for r in decontaminate.digest(docs, bench).collect()}
    for d, text in docs.collect():
        words, hit, owners = WORD.findall(low(text)), set(), set()
        index = defaultdict(list)
        for i in range(len(words) - 9):
            index[tuple(words[i : i + 10])].append(i)
        for item, w in items:
            for k in range(len(w) - 9):
                for i in index.get(tuple(w[k : k + 10]), ()):
                    hit.update(range(i, i + 10))
                    owners.add(str(item))
        r = rows[d]
        assert (r.n_words, r.n_hit, r.n_items) == (len(words), len(hit), len(owners))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()


def test_decontamination_in_blocks_short_items_and_removal(spark, docs, edge, none, monkeypatch):
    bench = spark.createDataFrame([(1, "Short item"), (2, None), (3, "--"), (4, "a b c d e f g h i j k l"), (1, "Short item")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "x SHORT, item y", 1), (2, "one a b c d e f g h i j k l two three four five six seven eight nine ten eleven twelve thirteen", 1), (3, None, 1), (4, "short item", 1)], "doc_id long, text string, items int")
    whole = sorted(map(tuple, decontaminate.digest(texts, bench).collect()))
    kept = sorted(map(tuple, decontaminate.remove(texts, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)
    assert sorted(map(tuple, decontaminate.digest(texts, bench).collect())) == whole
    assert sorted(map(tuple, decontaminate.remove(texts, bench).collect())) == kept
    assert {r[0]: r[2] for r in whole} == {1: 2, 2: 12, 3: 0, 4: 2}
    assert {r[0]: r[1] for r in kept} == {2: "one  two three four five six seven eight nine ten eleven twelve thirteen", 3: None}
    assert decontaminate.digest(edge, bench.limit(0)).count() == edge.count() and decontaminate.digest(none, bench).count() == 0


def brute_hits(words, items):
    """Hit positions and the owners, by plain search of every window of every item."""
    hit, owners = set(), set()
    for item, found in items:
        n = min(10, len(found))
        for k in range(len(found) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == found[k : k + n]:
                    hit.update(range(i, i + n))
                    owners.add(item)
    return hit, owners


def test_decontamination_of_items_of_all_lengths(spark, monkeypatch):
    rng = random.Random(6)
    some = lambda low, high: " ".join(rng.choices(["a", "B", "c", "é"], k=rng.randint(low, high)))
    items = [(rng.choice([*range(6), None]), rng.choice([None, "", some(1, 4), some(3, 9), some(10, 16)])) for _ in range(12)]
    items += [(7, " ".join(f"w{i}" for i in range(20))), (8, "w4 W5 w6")]
    texts = [(i % 150, some(0, 60), "x", 1, None) for i in range(200)] + [(500, " ".join(f"w{i}" for i in range(20)), "x", 1, None), (None, "w4 w5 w6", "x", 1, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, words string, Ranges int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(item, WORD.findall(low(text))) for item, text in items]
    want = []
    for d, text, *_ in texts:
        words = WORD.findall(low(text))
        hit, owners = brute_hits(words, known)
        names = ",".join(sorted(str(o) for o in owners if o is not None))
        want.append((d, len(words), len(hit), len(owners), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    for size in (decontaminate.BLOCK_WORDS, 15):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        assert sorted(map(tuple, decontaminate.digest(docs, bench).collect()), key=str) == sorted(want, key=str)
        kept = decontaminate.remove(docs, bench, drop_share=2.0)
        assert kept.columns == docs.columns and kept.count() == len(texts)
        assert {r.doc_id: r.text for r in kept.collect()}[500] == ""


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bpe.default_path())
    made.no_padding()
    made.no_truncation()
    return made


def test_bpe_equals_the_library(library):
    model, rng = bpe.Model(bpe.default_path()), random.Random(3)
    lexicon = bpe.Lexicon(bpe.Lexicon.pack(["the", "hello", "123", "é"], model.merge))
    assert lexicon.lookup("hello") == model.merge("hello") and lexicon.lookup("helium") is None and lexicon.lookup("") is None
    codec = bpe.Codec(model, lexicon)
    parts = ["'s", "'LL", "é", "e\u0301", "Σ", "ΑΣ ", "İ", "ß", "½", "1", "漢字", "\u200b", "\u00a0", " ", "\x1c", "\x85", "<|endoftext|>", "<|endof", "the", "Hello ", "!!", "\n", "🙂", "x" * 100, "_"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert next(codec.encode([text])) == ids, text
        decoded = library.decode(ids, skip_special_tokens=False)
        assert codec.decode(ids) == decoded
        told = next(codec.digests([text]))
        assert told == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_query_and_round_trip(library, docs, edge, none):
    path = bpe.default_path()
    for df in (docs, edge):
        want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in df.select("doc_id", "text").collect()}
        rows = {r.doc_id: r for r in bpe.encode(df, path).collect()}
        assert {d: list(r.ids) for d, r in rows.items()} == want
        back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, path), path).collect()}
        assert back == {d: library.decode(ids, skip_special_tokens=False) for d, ids in want.items()}
    assert bpe.digest(none, path).count() == 0


# URLs


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://WWW.Example.com/en/a?x"), (2, "http://example.com/en/"), (3, "http://a.b.net/es/x"), (4, "x://foo.com"), (5, None), (6, "no scheme"), (7, "http://h?q/es/"), (8, "http://notexample.com/en/"), (9, "http://de.org/%C3%A9"), (9, "http://de.org/%C3%A9"),
    ]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert (found[2].rule, found[2].verdict) == ("example.com/en/", "block")
    assert found[3].rule == "net/es/" and found[4].rule is None and found[4].path == ""
    assert (found[5].host, found[5].path) == ("", "") == (found[6].host, found[6].path)
    assert (found[7].host, found[7].path) == ("h", "") and found[8].rule == "com/"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_tells_the_classes_apart(spark):
    good = [(f"http://docs{i}.org/guide/page{i}", True) for i in range(200)]
    bad = [(f"http://win-casino-bonus{i}.biz/xxx?{i}", False) for i in range(200)]
    training = spark.createDataFrame(good + bad, "url string, good boolean")
    pages = spark.createDataFrame([(1, "http://docs.org/guide/page"), (2, "http://casino-bonus.biz/xxx")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, training, rules=()).collect()} == {1: "allow", 2: "block"}


def test_url_model_reads_query_fragment_and_urls_without_scheme(spark):
    good = [(f"http://site{i}.org/p?guide=page{i}", True) for i in range(200)]
    bad = [(f"http://site{i}.org/p?casino=bonus{i}", False) for i in range(200)]
    training = spark.createDataFrame(good + bad, "url string, good boolean")
    asked = ["http://site.org/p?guide=page", "http://site.org/p?casino=bonus", "http://site.org/p#guide=page", "http://site.org/p#casino=bonus", "site.org/p?guide=page", "site.org/p?casino=bonus"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, training, rules=()).collect()} == {i: ("allow", "block")[i % 2] for i in range(6)}


def brute_url_scores(known, asked):
    """Witten-Bell models of orders 0 to 2 over the folded alphabet, straight from the counts."""
    from math import log

    alphabet = urls._ALPHABET

    def codes(text):
        folded = re.sub("[0-9]", "0", low(text))
        return [alphabet.index(c) if c in alphabet else 30 for c in folded]

    def triples(text):
        c = [urls.EDGE, urls.EDGE, *codes(text), urls.EDGE]
        return list(zip(c, c[1:], c[2:]))

    models = []
    for good in (True, False):
        three = Counter(t for text, label in known if label == good for t in triples(text))
        two, one = Counter(), Counter()
        for (_, b, c), n in three.items():
            two[b, c] += n
            one[c] += n

        def p(t, three=three, two=two, one=one):
            a, b, c = t
            p0 = (one[c] + 1) / (sum(one.values()) + urls.SYMBOLS)
            follow = {k: n for k, n in two.items() if k[0] == b}
            p1 = (two[b, c] + len(follow) * p0) / (sum(follow.values()) + len(follow)) if follow else p0
            follow = {k: n for k, n in three.items() if k[:2] == (a, b)}
            return (three[t] + len(follow) * p1) / (sum(follow.values()) + len(follow)) if follow else p1

        models.append(p)
    return [sum(log(models[0](t)) - log(models[1](t)) for t in triples(x)) / len(triples(x)) for x in asked]


def test_url_scores_against_brute_force(spark):
    rng = random.Random(8)
    made = lambda words: "https://" + "-".join(rng.choices(words, k=2)) + f".org/É{rng.randint(0, 99)}?q=_"
    rows = [(made(["news", "park", "lab"]), True) for _ in range(60)] + [(made(["win", "casino", "lab"]), False) for _ in range(60)]
    training = spark.createDataFrame(rows, "url string, good boolean")
    hashed = training.withColumn("held", chat.F.pmod(chat.F.xxhash64(urls._text(chat.F.col("url"))), chat.F.lit(10)) == 0)
    known = [(r.url.split("://")[1], r.good) for r in hashed.where("not held").collect()]
    asked = ["https://park-news.org/1", "x", "http://casino.biz/É?", None, "https://win-win.org/"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string").withColumn("score", chat.F.lit("other"))
    found = {r.page_id: r.score for r in urls.judge(pages, training, rules=()).collect()}
    want = brute_url_scores(known, [(u or "").split("://")[-1] for u in asked])
    assert [found[i] for i in range(len(asked))] == pytest.approx(want, abs=1e-9)


def test_urls_label_themselves_and_rules_come_first(spark):
    rows = [(i, f"https://www.garden{i % 7}.example.net/en/{i}") for i in range(120)] + [(200 + i, f"https://free-casino.example.org/de/{i}") for i in range(40)] + [(300, "https://casino.example.com/de/1"), (301, "https://garden.example.net/fr/1"), (302, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: r for r in urls.judge(pages).collect()}
    assert {found[i].verdict for i in range(120)} == {"allow"} and {found[200 + i].verdict for i in range(40)} == {"block"}
    assert (found[300].rule, found[300].verdict, found[301].rule, found[301].verdict) == ("com/", "allow", "net/fr/", "block")
    assert found[302].verdict in ("allow", "block")
    for url, bad in (("http://a.org/free-bets/x", True), ("http://alphabet.org/", False), ("http://x.org/a?casino=1", False), ("http://ADS.x.org", True)):
        assert spark.range(1).select(urls.unwanted(chat.F.lit(url)).alias("v")).first().v == bad


# Licenses


def test_license_places_and_templates(docs, edge, none):
    scanner, rng = licenses.Scanner(), random.Random(1)
    vocabulary = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "Free"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(2000)] + [r.text for r in docs.collect()]
    for text in texts:
        words = WORD.findall(low(text))
        want = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        n, base, _, _ = scanner.scan(text)
        assert (n, sorted(base)) == (len(words), want)
    for label, template in licenses.TEMPLATES:
        assert scanner.scan("before it " + template + " after")[2][label] == 1.0
    assert licenses.scan(edge).count() == edge.count() and licenses.scan(none).count() == 0


def test_license_chains_against_brute_force():
    """Labels and shares of edited templates, by the best ordered cover of common runs."""
    scanner, rng = licenses.Scanner(), random.Random(11)

    every = [(label, WORD.findall(low(t))) for t, label in licenses.PHRASES] + [(label, WORD.findall(low(t))) for label, t in licenses.TEMPLATES]

    def longest(found, end):
        """The longest run of words of any template that ends before ``end``."""
        n = 0
        while n < end and any(t[j : j + n + 1] == found[end - n - 1 : end] for _, t in every for j in range(len(t) - n)):
            n += 1
        return n

    def brute(found):
        """By label, the largest share covered by runs that are longest where they end, in the order of text and template."""
        runs = [longest(found, end) for end in range(len(found) + 1)] + [0]
        ends = [(end, n) for end, n in enumerate(runs[:-1]) if n >= licenses.MIN_RUN and runs[end + 1] != n + 1]
        shares = {}
        for label, t in every:
            at = sorted((end, j + n, n) for end, n in ends for j in range(len(t) - n + 1) if t[j : j + n] == found[end - n : end])
            best = []
            for k, (end, stop, n) in enumerate(at):
                best.append(max([n, *(best[m] + min(n, stop - s, end - e) for m, (e, s, _) in enumerate(at[:k]) if e < end and s < stop and end - n - e <= licenses.GAP)]))
            if best:
                shares[label] = max(shares.get(label, 0.0), min(1.0, max(best) / len(t)))
        return shares

    for _ in range(40):
        words = WORD.findall(low(rng.choice(licenses.TEMPLATES)[1]))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 8)] = rng.choices(["zzz", "the", "software"], k=rng.randint(0, 30))
            words = words or ["x"]
        assert scanner.scan(" ".join(words))[2] == pytest.approx(brute(words))


def test_license_statements_add_their_labels(spark):
    rows = spark.createDataFrame([(1, "x. Licensed under CC BY-NC 4.0. y", 1), (2, "Licensed under CC BY 4.0.", 1), (3, "cc by", 1)], "doc_id long, text string, labels int")
    found = {r.doc_id: (r.base_labels, r.labels, [(s.label, s.start, s.end) for s in r.spans]) for r in licenses.scan(rows).collect()}
    assert found == {1: ("cc-by", "cc-by,cc-by-nc", [("cc-by-nc", 1, 8)]), 2: ("cc-by", "cc-by", [("cc-by", 0, 6)]), 3: ("cc-by", "cc-by", [])}


def test_suffix_automaton_matching_statistics():
    rng = random.Random(2)
    sequences = [[rng.randint(1, 3) for _ in range(12)] for _ in range(3)]
    automaton = licenses.SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(12) for j in range(i, 13)}
    for _ in range(500):
        run, state = [rng.randint(1, 3) for _ in range(rng.randint(0, 8))], 0
        for symbol in run:
            state = automaton.next[state].get(symbol) if state is not None else None
        assert (state is not None) == (tuple(run) in runs)


# HTML


def test_field_on_held_out_pages():
    field, wrong, total = htmltext.trained(), 0, 0
    for page, known in htmltext.labelled_pages(120, seed=99):
        found = htmltext.blocks(page)
        assert [b[0] for b in found] == [text for text, _ in known]
        wrong += sum(a != b for a, (_, b) in zip(field.labels(found), known))
        total += len(known)
    assert wrong < 0.02 * total


def test_viterbi_finds_the_best_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(60):
        field = htmltext.Field(rng.normal(size=len(htmltext.NAMES)), rng.normal(size=(2, 2)))
        found = [("x", frozenset(rng.integers(0, len(htmltext.NAMES), 2).tolist()), rng.integers(0, len(htmltext.NAMES), 3).tolist()) for _ in range(rng.integers(1, 9))]
        emit = [field.weights[htmltext.NUMBER["bias"]] + sum(field.weights[f] for f in [*above, *own]) for _, above, own in found]

        def value(labels, emit=emit, field=field):
            return sum(e for e, y in zip(emit, labels) if y) + sum(field.steps[a][b] for a, b in zip(labels, labels[1:]))

        assert value(field.labels(found)) == pytest.approx(max(map(value, product((0, 1), repeat=len(found)))))


def test_html_extra_columns_and_long_pages(spark):
    body = "<article><h1>T</h1>" + "<p>Some words of an article stand here.</p>" * 120_000 + "</article>"  # longer than a slice
    rows = [(1, "u", body, "x"), (1, "u", body, "x"), (None, None, "<p>Only a line of text that says something.</p>", "x")]
    found = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == 3 and len({r.n_chars for r in found if r.page_id}) == 1 and found[0].n_chars == len(found[0].text) > 4_000_000


def test_html_text_of_pages(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy this now, it is on sale.</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>Three&nbsp;four</p></article><section class="comments"><p>Nice article, thank you.</p></section><footer>&copy; x</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (4, "u", "<p")]
    found = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "A & B\nOne two\nThree four" and found[1].n_chars == len(found[1].text)
    assert found[2].text == found[3].text == found[4].text == ""


# Near duplicates


def brute_components(rows, p):
    sets = {}
    for d, text in rows:
        words = (text or "").encode().translate(neardup._LOWER).split()
        k = min(p.words, len(words))
        sets[d] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= p.percent * (len(sets[a]) + len(sets[b]) - inter):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("p", [neardup.STRICT, neardup.LOOSE])
def test_near_duplicates_against_brute_force(spark, docs, p):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [tuple(r) for r in docs.collect()] + [(10_000, None), (10_001, ""), (10_002, "One two"), (10_003, "one TWO"), (10_004, "one")]
    for k in range(60):  # a family of edited copies: many pairs near the threshold
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((20_000 + k, " ".join(words)))
    rng.shuffle(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert found == brute_components(rows, p)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for n in (1, 3, 40, 900):
        items = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        assert (neardup.sketches([items], 160) != neardup._EMPTY).all()
    for _ in range(60):
        items = np.unique(rng.integers(0, 2**62, 100).astype(np.uint64))
        a, b = neardup.sketches([items[:90], items[10:]], 160)
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.035


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (2, b + " more"), (3, c), (3, c), (4, ""), (4, ""), (None, a)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, number int, Mark string")
    found = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.classes(docs).collect())
    assert found == Counter({(1, 1, True): 2, (2, 1, False): 2, (3, 3, True): 2, (4, 4, True): 2, (None, None, False): 1})
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (1, b), (3, c), (4, ""), (4, ""), (None, a)])


def test_near_duplicate_edges(spark, edge, none):
    rows = spark.createDataFrame([(None, "a b c d", 1), (1, "a b c d", 2), (2, "a b c d", 3), (2, "a b c d", 3)], "doc_id long, text string, kept int")
    found = sorted(map(tuple, neardup.classes(rows).collect()), key=str)
    assert found == sorted([(None, 2, None, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)], key=str)
    kept = neardup.keep_first(rows)
    assert kept.columns == rows.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a b c d"), (None, "a b c d")]
    assert neardup.classes(none).count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 800 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    rows = [(1, "http://a/", long, 1), (2, "http://b/", long, 1), (3, None, None, 1), (4, "u\r\nX: y", "short", 1), (5, "u", "short", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, response int")
    again = pages.unionByName(spark.createDataFrame([(None, "u", long, 1), (None, "u", long, 1), (5, "u", "other", 1), (5, "u", "short", 1), (1, "x", "é" * 700, 1)], pages.schema))
    told = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.digest(again).collect())
    size = len(long.encode())
    assert told == Counter({(1, size, "revisit", 2): 1, (2, size, "response", None): 1, (None, size, "response", None): 2, (3, 0, "response", None): 1, (4, 5, "response", None): 1, (5, 5, "response", None): 3, (1, 1400, "response", None): 1})
    found = {r.page_id: r for r in warc.digest(pages).collect()}
    assert (found[1].record_type, found[1].refers_to, found[2].record_type, found[2].refers_to) == ("revisit", 2, "response", None)
    assert found[1].payload_digest == hashlib.sha1(long.encode()).hexdigest() and found[1].payload_bytes == len(long.encode())
    assert found[3].payload_bytes == 0 and found[4].record_type == found[5].record_type == "response"
    nested = {r.response.page: r for r in warc.round_trip(pages).collect()}
    assert len(nested) == 5 and all(r.request and r.response and r.metadata for r in nested.values())
    assert nested[2].response.body == long and nested[1].response.refers_to == nested[2].capture
    assert warc.digest(pages.limit(0)).count() == 0


def test_archives_are_read_in_pieces(monkeypatch):
    import gzip

    record = lambda body: b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <x>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    bodies = [b"", b"\r\n\r\nWARC/1.1\r\n", "é".encode() * 5000, b"x"]
    one = gzip.compress(b"".join(map(record, bodies)))
    for data in (one, one + one, b"".join(gzip.compress(record(b)) for b in bodies)):
        for piece in (1, 7, 1 << 18):
            monkeypatch.setattr(warc, "PIECE", piece)
            found = [r[-1].encode() for r in warc._parse(warc._inflated(data))]
            assert found == bodies * (len(found) // 4) and found
    with pytest.raises(ValueError):
        list(warc._parse(warc._inflated(one[:-30])))


# Chat


def test_chat_formatting_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b", "<\\|", "<|user|>", "<sep>", None, "", "x|>y", "\\", "<<SYS>>\n"]
    rows = [(i % 3, i // 3, ["user", "assistant", "user", "we|>ird", None][i % 5], t) for i, t in enumerate(texts * 6)] + [(0, 0, "user", "tie")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.chats(turns).select("conv_id", "formatted", "mask", chat.read_back(chat.F.col("formatted")).alias("back")).collect()
    for r in made:
        want = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(run.role, text) for run in r.back for text in run.texts] == [(role, text) for _, role, text in want]
        assert all(a.role != b.role for a, b in zip(r.back, r.back[1:]))
        at, loss = 0, []
        for piece in r.mask:
            loss += [r.formatted[at : at + piece.chars]] * piece.loss
            at += piece.chars
        assert at == len(r.formatted)
        assert re.sub(r"(?s)\\(.)", r"\1", "".join(loss)) == "".join(t for _, role, t in want if role == "assistant")
    assert chat.digest(turns.limit(0)).count() == 1  # the probe alone


def test_pipeline_stages_against_brute_force(spark, sf, library):
    """Every stage on what the one before kept, by the plain versions above."""
    import corpus_pipeline

    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, WORD.findall(low(r.text))) for r in bench.collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    frame = lambda kept: spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in kept.items()], docs.schema)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    forest = quality.train(docs, labels)
    want = {}
    for d, text in rows.items():
        n, _, _, _, repeats = brute_statistics(text)
        if n >= 20 and 100 * repeats <= 30 * n and walked(forest, quality.statistics(text)[1]) >= forest.threshold:
            want[d] = text
    assert texts(stages["quality"](spark, docs, sf)) == want
    rows, kept = want, brute_components(want.items(), neardup.LOOSE)
    want = {d: t for d, t in rows.items() if kept[d][2]}
    assert texts(stages["neardup"](spark, frame(rows), sf)) == want

    rows, want = want, {}
    for d, text in rows.items():
        found = list(WORD.finditer(low(text)))
        hit, _ = brute_hits([m[0] for m in found], items)
        if hit and 2 * len(hit) >= len(found):
            continue
        out, done = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                out += text[done : found[i].start()]
            done = found[i].end()
        want[d] = out + text[done:]
    assert len(want) <= len(rows) and texts(stages["decontaminate"](spark, frame(rows), sf)) == want

    rows, scanner = want, secrets._scanner(secrets.RULES)
    for d, text in rows.items():
        data = text.encode()
        spans = brute_secrets(data) + [s for s in scanner.spans(data) if s[2] > 2]
        covered = {k for s, e, _ in spans for k in range(s, e)}
        starts = {s for s, _, _ in spans if s - 1 not in covered or any(e == s for _, e, _ in spans)}
        want[d] = b"".join(b"[secret]" * (k in starts) if k in covered else data[k : k + 1] for k in range(len(data))).decode()
    assert texts(stages["secrets"](spark, frame(rows), sf)) == want
    last = {r.doc_id: list(r.ids) for r in stages["encode"](spark, frame(want), sf).collect()}
    assert last == {d: library.encode(t, add_special_tokens=False).ids for d, t in want.items()}


def test_extra_columns_with_clashing_names(spark, docs):
    wide = docs.limit(40)
    for name in ("n_words", "spans", "labels", "keys", "mark", "node", "_words", "_row", "set_a", "component_id", "ids", "probability"):
        wide = wide.withColumn(name, chat.F.lit("other"))
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, n_words string")
    for made in (secrets.digest(wide), quality.judge(wide, labels), decontaminate.digest(wide, docs.limit(0).withColumnRenamed("doc_id", "item_id")), bpe.digest(wide, bpe.default_path()), licenses.scan(wide), neardup.classes(wide)):
        assert made.count() == 40
    for made in (secrets.redact(wide), quality.keep_good(wide, labels), neardup.keep_first(wide)):
        assert made.columns == wide.columns
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", "y"), (1, 1, "assistant", "b", "x", "y")], "conv_id long, turn long, role string, text string, turns string, runs string")
    assert chat.digest(turns).count() == 2


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.digest(docs.select("doc_id", "text"), bench).where("contaminated").count() == 0
    assert secrets.digest(docs.select("doc_id", "text")).where("spans <> ''").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == before and set(last.columns) >= {"doc_id", "ids"}
