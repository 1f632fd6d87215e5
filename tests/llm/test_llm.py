import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veristrata.llm import decontaminate, langid, licenses, lm_score, mixing, near_dedup, pii, pu_quality, quality_rules, url_filters
from veristrata.llm.words import chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, texts, **more):
    """Documents with nulls, and with extra columns that carry operators' own names."""
    rows = [(i, t, more.get("lang", {}).get(i), more.get("source", {}).get(i), len(t) if t is not None else None, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(t):
    return (t or "").encode().split()


ODD = [None, "", " \t\n ", "one", "é\xa0ü x", "a b c d e f g h i j", "a b c d e " * 6, "# $ % | < >\nx\nx\n\nx", "w" * 50_000, "A b\x0bC\fd\x85e", "line one\nline one\nline two"]


def test_words_and_hashes():
    raw = pa.array([(t or "").encode() for t in ODD], pa.binary())
    seen = {}
    for i, j, c in chunks(raw):
        found = [[] for _ in range(j - i)]
        for d, s, e, h in zip(c.doc, c.starts, c.ends, c.word_hash(), strict=True):
            w = c.buf[s:e].tobytes()
            found[d].append(w)
            assert seen.setdefault(w, h) == h
        assert found == [words_of(t) for t in ODD[i:j]]
    assert len(set(seen.values())) == len(seen)


def brute_measures(t):
    w = words_of(t)
    t = t or ""
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(ch in "#*$%&|<>" for ch in t), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choices(WORDS[:4], k=rng.randint(0, 60))) for _ in range(40)] + ["\n".join(rng.choices(["a b", "c", ""], k=8)) for _ in range(10)]
    rows = {r.doc_id: r for r in quality_rules.ledger(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][m] for m in quality_rules.MEASURES) == brute_measures(t), repr(t)[:80]
    ledger = quality_rules.ledger(frame(spark, texts)).cache()
    total = {(r.policy, r.rule): r for r in quality_rules.ablation(ledger).collect()}
    base = [r for r in rows.values() if r.failed_rules & 3]
    assert total[("base", "too_few_words")].policy_dropped == len(base)
    assert total[("base", "too_few_words")].n_alone == sum(r.failed_rules & 3 == 1 for r in base)
    assert quality_rules.ledger(frame(spark, [])).count() == 0


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([ -]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_pii_equals_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + ["a@b.com_x@y.zz", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.0 0001.002.3.255", "9" * 3000, "x@" + "y." * 5000 + "z", "4111-1111-1111-1111 1", "😀 +1 (017) 555-7713 a@b.co", "+49 (0) 30 123456 7 "]
    texts += ["".join(rng.choices("01 -.+()@ab9%\n", k=rng.randint(1, 60))) for _ in range(800)] + ["".join(rng.choices("0123456789 -", k=rng.randint(10, 30))) for _ in range(600)]
    for r in pii.find_pii(frame(spark, texts)).collect():
        assert r.base_sha256 == hashlib.sha256(brute_pii(texts[r.doc_id]).encode()).hexdigest(), repr(texts[r.doc_id])


def test_pii_adds_confirmed_kinds_and_redacts(spark):
    texts = ["DE89 3704 0044 0532 0130 00 konto", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "row 123-45-6789", "call 555-123-4567 now", "see 555-123-4567", "clean", None]
    spans = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, texts)).collect()}
    assert [spans[i] for i in range(8)] == ["iban:0:27", "", "ssn:4:15", "", "localphone:5:17", "", "", ""]
    red = {r.doc_id: r for r in pii.redact(frame(spark, ["mail a@b.co now", "clean", None])).collect()}
    assert red[0].text == "mail <EMAIL> now" and red[0].n_chars == 16 and red[1].text == "clean" and red[2].text is None and red[0].kept == "x"


def brute_groups(texts, k, percent=80):
    sets = []
    for t in texts:
        w = [x.lower() for x in words_of(t)]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(6):
        base = rng.choices(WORDS, k=rng.randint(3, 60))
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper())
    chain = rng.choices(WORDS, k=80)
    for i in range(12):
        chain = [*chain[:-1], WORDS[i]] if i % 2 else [*chain[1:], WORDS[i]]
        texts.append(" ".join(chain))
    texts += texts[-3:]
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, texts), k=k).collect()}
    want = brute_groups(texts, k)
    assert [(rows[i].n_shingles, rows[i].component_id) for i in range(len(texts))] == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows.values())


def test_a_large_family_just_below_the_threshold_loses_no_link(spark):
    """2,000 copies of one text of 150 words with 4 to 13 words replaced, of which some repeat another copy's changes."""
    rng = random.Random(33)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(2000):
        copy = list(base)
        if i % 10 == 0 and i:
            copy = texts[rng.randrange(i)].split()
        for _ in range(rng.randint(4, 13) if i % 10 else rng.randint(1, 6)):
            copy[rng.randrange(150)] = f"x{i}y{rng.randrange(40)}" if rng.random() < 0.8 else rng.choice(base)
        texts.append(" ".join(copy))
    ids: dict = {}
    rows = [[ids.setdefault(pair, len(ids)) for pair in zip(t.split(), t.split()[1:], strict=False)] for t in texts]
    marks = np.zeros((2000, len(ids)), np.float32)
    for i, r in enumerate(rows):
        marks[i, r] = 1
    both, n = marks @ marks.T, marks.sum(axis=1)
    near = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    want = np.arange(2000)
    while True:
        least = np.where(near, want[None, :], 2000).min(axis=1)
        if (least == want).all():
            break
        want = least
    assert 20 < len(set(want.tolist())) < 1900 and near.sum() > 4000
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, texts), k=2).collect()}
    assert [got[i] for i in range(2000)] == want.tolist()


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_dedup.near_duplicates(frame(spark, []), k=2).count() == 0
    df = frame(spark, ["a b c", "a b c", "x"])
    twice = near_dedup.near_duplicates(df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long"))), k=2).collect()
    assert len(twice) == 9 and Counter((r.doc_id, r.component_id) for r in twice) == {(0, 0): 2, (1, 0): 2, (2, 2): 2, (None, 0): 2, (None, 2): 1}


def test_gru_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.BiGRU(3, 4)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    codes, lengths, target = rng.integers(0, 256, (5, 7), dtype=np.uint8), np.array([7, 5, 5, 2, 1]), np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(codes, lengths, target)
    for k, v in net.p.items():
        at = np.unravel_index(np.argmax(abs(g[k])), g[k].shape)
        old, ends = v[at], []
        for step in (1e-4, -1e-4):
            v[at] = old + step
            ends.append(net.gradients(codes, lengths, target)[0])
        v[at] = old
        assert abs((ends[0] - ends[1]) / 2e-4 - g[k][at]) < 1e-4, k


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "ich"]}
    lang, texts = {}, []
    for i in range(160):
        lang[i] = "aa" if i % 2 else "bb"
        texts.append(" ".join("".join(rng.choices(parts[lang[i]], k=3)) for _ in range(30)))
    texts += [None, "", "123 456", "!?", "katomi " * 40_000]
    df = frame(spark, texts, lang=lang)
    model = langid.train(langid.training_sample(df, F.col("doc_id") % 3 != 1))
    rows = {r.doc_id: r for r in langid.identify(df, model, "doc_id").collect()}
    assert all(rows[i].lang_pred == lang[i] for i in range(160)) and rows[164].lang_pred == "aa"
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in range(160, 164))
    assert all(0 <= r.score <= 1 for r in rows.values())
    none = langid.train(langid.training_sample(frame(spark, ["a", None]), F.lit(True)))
    assert [r.lang_pred for r in langid.identify(frame(spark, ["a", None]), none, "doc_id").collect()] == ["und", "und"]


def test_network_equals_plain_loops():
    """Each position's label from gates computed one by one; a document's probabilities pool them."""
    model = langid.train([("aa", b"kato mira toka mika " * 20), ("bb", b"schung verich ungsch " * 20)], 200)
    p, h = model.net.p, model.net.h
    sig = lambda x: 1 / (1 + math.exp(-x))

    def run(d, codes):
        state, out = [0.0] * h, []
        for c in codes:
            x, u, bias = p["x" + d][c], p["u" + d], p["c" + d]
            rec = [sum(state[i] * float(u[i, j]) for i in range(h)) for j in range(3 * h)]
            z = [sig(float(x[j]) + rec[j]) for j in range(h)]
            r = [sig(float(x[h + j]) + rec[h + j]) for j in range(h)]
            new = [math.tanh(float(x[2 * h + j]) + r[j] * (rec[2 * h + j] + float(bias[j]))) for j in range(h)]
            state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
            out.append([sum(state[i] * float(p["o" + d][i, k]) for i in range(h)) for k in range(2)])
        return out

    long = " ".join(["kato schung 12 mi", "x" * 130, "ungver -- 7"] * 4)
    for text in ("kato schung mi", "12 ungvermika 12 x 3", "w" * 100, long, "é" * 90 + " 1\n2 ungé"):
        raw, spans = text.encode(), []
        for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
            if re.search(rb"[A-Za-z\x80-\xff]", m[0]):
                spans += [(at, min(at + langid.PIECE, m.end())) for at in range(m.start(), m.end(), langid.PIECE)]
        runs = {}
        for start, end in spans:
            runs.setdefault((start - spans[0][0]) // langid.SPAN, []).append((start, end))
        total, n = [0.0, 0.0], 0
        for read in runs.values():
            whole = raw[read[0][0] : read[-1][1]]
            ahead, behind = run("f", whole), run("b", whole[::-1])[::-1]
            for at, (a, b) in enumerate(zip(ahead, behind, strict=True), read[0][0]):
                if not any(start <= at < end for start, end in read):
                    continue
                logits = [a[k] + b[k] + float(p["b"][k]) for k in range(2)]
                norm = math.log(sum(math.exp(x) for x in logits))
                total = [t + x - norm for t, x in zip(total, logits, strict=True)]
                n += 1
        share = [math.exp(t / n) for t in total]
        # Texts beside it change nothing.
        ((_, _, chunk),) = chunks(pa.array([b"mika", raw, b"", b"12"], pa.binary()))
        best, score = model.predict(chunk)
        assert best[1] == int(share[1] > share[0]) and abs(score[1] - max(share) / sum(share)) < 1e-4


DATA = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no driver tables")


@needs_tables
def test_held_out_figures(spark):
    """Language, quality and language-model scores of rows that were not learned from."""
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in langid.op5_language_id(spark, DATA).collect() if r.held_out and docs[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in found]) > 0.97
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    judged = [(quality[r.doc_id], r.score, r.predicted) for r in pu_quality.op10_pu_quality(spark, DATA).collect() if r.held_out and r.doc_id in quality]
    good, bad = [s for q, s, _ in judged if q == 1], [s for q, s, _ in judged if q == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
    assert np.mean([p == q for q, _, p in judged]) > 0.93
    scored = [r for r in lm_score.op7_suffix_tree(spark, DATA).collect() if r.held_out]
    assert sum(r.score for r in scored) > 0.95 * sum(r.base_score for r in scored)


def test_every_language_label_is_learned(spark):
    names = [f"l{i:02d}" for i in range(70)]
    lang = {i: names[i // 2] for i in range(140)}
    # Each language has three letters of its own, in its own part of the alphabets.
    texts = ["".join(chr(0x4E00 + 64 * (i // 2) + k) for k in range(3)) * 4 for i in range(140)]
    df = frame(spark, texts, lang=lang)
    sample = langid.training_sample(df, F.lit(True))
    model = langid.train(sample)
    assert sorted({name for name, _ in sample}) == model.languages == names


def brute_rule(url):
    host, path = url_filters.split_url(url)
    fits = [(len(t), a, t) for a, t in url_filters.HOST_RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fits, default=(0, None, None))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.com", "http://a.COM/", "http://x.example.com/en/1?q#f", "https://www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/x", "http://cheap-pills.example.org/x", "http://a.org/wp-login.php?x", "http://a.org/ads/z.banner.png", "http://health-advice.pills.org/", "ftp://com/", "http://user@com/x", "http://example.com/EN/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    rows = {r.page_id: r for r in url_filters.filter_urls(df).collect()}
    for i, u in enumerate(urls):
        _, action, text = brute_rule(u)
        assert rows[i].rule == text and (action is None or rows[i].verdict == action), u
    lists = url_filters.rules()
    for u in urls:
        host, path = url_filters.split_url(u)
        hits = [r for r in lists if not r.is_host and re.search(r.regex, (host + path).lower())]
        if brute_rule(u)[1] is None:
            assert (rows[urls.index(u)].verdict == "block") == bool(hits and min(hits, key=lambda r: r.order).action == "block")
    index = url_filters.RuleIndex(lists, {})
    index.judge("http://plain.org/a/b")
    assert index.runs == 0 and rows[9].verdict == rows[10].verdict == rows[11].verdict == "block" and rows[12].verdict == "allow"


def test_suffix_tree_scores(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS[:6], k=rng.randint(0, 12))) for _ in range(60)] + ["Alpha beta gamma delta epsilon zeta"] * 30 + [None, "", "unseen words only"]
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    rows = {r.doc_id: r for r in lm_score.lm_scores(frame(spark, texts), part != 0, part == 0).collect()}
    tokens = lambda t: [*(w.lower() for w in words_of(t)), None]
    c = Counter(x for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n)
        assert abs(r.base_score - base) < 1e-9 and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert lm_score.lm_scores(frame(spark, []), part != 0, part == 0).count() == 0


def test_suffix_tree_distributions_sum_to_one():
    rng = random.Random(8)
    words = WORDS[:4]
    learned = [" ".join(rng.choices(words, weights=(9, 3, 2, 1), k=6)) for _ in range(60)] + [" ".join(words)] * 40
    befores = [[], [words[0]], [words[1]], words[:2], words[1:3], [words[3], words[3]], ["unseen"], [words[0], "unseen"]]
    # Every token that may follow: the words, an unseen one for the mass of all of them, and the end.
    probes = [" ".join([*before, *w]) for before in befores for w in ([words[0]], [words[1]], [words[2]], [words[3]], ["never"], [])]
    texts = pa.table({"learn": [True] * len(learned) + [False] * len(probes), "raw": pa.array([t.encode() for t in learned + probes], pa.binary())})
    key = (pa.scalar(0),)
    answers = lm_score._count_words(lm_score._ask_words(3)(key, texts))
    # One group of all tokens is what the groups are in sum; the rows of totals come first.
    total = answers.slice(0, 1).to_pylist()[0]
    answers, floor = answers.slice(1), math.log10(total["n"] + 0.1 * (total["v"] + 1))
    assert total["n"] == sum(len(t.split()) + 1 for t in learned) and total["v"] == 5
    for level in (1, 2):
        found = lm_score._fit_level(level, floor)(lm_score._ask_level(level, 3, floor)(key, texts, answers))
        assert sum(found.column("n").to_pylist()) > 0
        answers = pa.concat_tables([answers, found])
    block = lm_score.Block(texts, 3)
    block.walk(answers, 2, floor)
    for k, before in enumerate(befores):
        rows = [len(learned) + 6 * k + i for i in range(6)]
        total = sum(10 ** block.p[block.doc == r][len(before)] for r in rows)
        assert abs(total - 1) < 1e-9, before


def test_numbers_travel_by_their_bytes():
    rng = np.random.default_rng(4)
    for values in (rng.integers(-(2**62), 2**62, 9), rng.integers(0, 2**64, 5, dtype=np.uint64), rng.random(7), np.arange(3, dtype=np.int32), rng.random(13) < 0.5, np.zeros(0, bool), np.zeros(0)):
        assert (lm_score._unpacked(lm_score._packed(values), values.dtype) == values).all()
    logs = -rng.random(50) * 20
    cut = lm_score._unpacked(lm_score._packed(lm_score._fixed(logs), lm_score.FIXED_BYTES), np.int64, lm_score.FIXED_BYTES) / lm_score.FIXED
    assert np.abs(cut - logs).max() < 1e-10
    names = rng.integers(0, 2**64, 50, dtype=np.uint64)
    assert (lm_score._unpacked(lm_score._packed(names, 6), np.uint64, 6) >> np.uint64(16) == names >> np.uint64(16)).all()


def brute_suffix_tree(texts, learn):
    """Scores by dictionaries: counts of words, pairs and triples, and the rule that decides which contexts stay."""
    end = None
    lines = [[*(w.lower() for w in words_of(t)), end] for t in texts]
    one, two, three = Counter(), Counter(), Counter()
    for line, good in zip(lines, learn, strict=True):
        if good:
            one.update(line)
            two.update(zip(line, line[1:], strict=False))
            three.update(zip(line, line[1:], line[2:], strict=False))
    n, v, least = sum(one.values()), len(one), lm_score.MIN_COUNT
    root = lambda x: math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1)))
    often = {x for x, c in one.items() if c >= least}
    pairs = {p: c for p, c in two.items() if c >= least and set(p) <= often}
    triples = {t: c for t, c in three.items() if c >= least and t[:2] in pairs and t[1:] in pairs}

    def kept(entries, size, shorter):
        """The factor of what a context doesn't store, and the probabilities it stores; nothing if it isn't worth it."""
        held, mass = sum(entries.values()), sum(10 ** shorter[x] for x in entries)
        own = {x: math.log10(c / (size + lm_score.NOVEL)) for x, c in entries.items()}
        left = math.log10((size - held + lm_score.NOVEL) / (size + lm_score.NOVEL)) - math.log10(max(1 - mass, 1e-9))
        gain = (sum(c * (own[x] - shorter[x]) for x, c in entries.items()) + (size - held) * left) * math.log(10)
        return (left, own) if mass < 1 - 1e-9 and gain >= lm_score.MIN_GAIN + lm_score.ENTRY_COST * len(entries) else (0.0, {})

    def tree(found, size, shorter):
        by = {}
        for key, c in found.items():
            by.setdefault(key[:-1], {})[key[-1]] = c
        return {k: kept(e, size(k), {x: shorter(k, x) for x in e}) for k, e in by.items()}

    first = tree(pairs, lambda k: one[k[0]], lambda k, x: root(x))
    step = lambda states, k, x, p: states[k][1].get(x, p + states[k][0]) if k in states else p
    second = tree(triples, lambda k: pairs[k], lambda k, x: step(first, k[1:], x, root(x)))
    out = []
    for line in lines:
        total = 0.0
        for i, x in enumerate(line):
            p = root(x)
            if i:
                p = step(first, (line[i - 1],), x, p)
            if i > 1:
                p = step(second, (line[i - 2], line[i - 1]), x, p)
            total += p
        out.append(total)
    return out, len([1 for left, own in second.values() if own])


def test_suffix_tree_equals_brute_force(spark, monkeypatch):
    # Several blocks and groups, so that counts meet from all of them.
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", 2000)
    rng = random.Random(16)
    texts = []
    for _ in range(150):
        words = rng.choices(WORDS[:8], k=rng.randint(0, 15))
        if rng.random() < 0.5:
            words += "alpha beta gamma delta epsilon".split()[: rng.randint(2, 5)]
        texts.append(" ".join(words) if rng.random() < 0.9 else " ".join(words).upper())
    texts += [None, "", "never seen", *texts[:5]]
    learn = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    got = {r.doc_id: r.score for r in lm_score.lm_scores(frame(spark, texts), part != 0, part == 0).collect()}
    want, deep = brute_suffix_tree(texts, learn)
    assert deep > 3 and all(abs(got[i] - w) < 1e-6 for i, w in enumerate(want))


def test_suffix_tree_learns_a_rare_phrase_in_a_large_corpus(spark):
    phrase = "alpha beta gamma delta"
    df = frame(spark, ["filler " * 2_500_000, phrase, phrase, phrase])
    held = F.col("doc_id") == 3
    row = lm_score.lm_scores(df, ~held, held).where("held_out").first()
    assert row.train_tokens > 2_500_000 and row.score > row.base_score + 10


def test_targets_are_the_reshared_weights():
    def reshared(sizes):
        names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
        w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
        done, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
        while True:
            share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
            over = [s for s in open_ if share[s] > 2 * sizes[s]]
            if not over:
                return done | share
            for s in over:
                done[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
                open_.remove(s)

    rng = random.Random(7)
    for _ in range(50):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 100, 5000]) for i in range(rng.randint(1, 8))} | ({None: 50} if rng.random() < 0.5 else {})
        got, want = mixing.source_targets(sizes), reshared(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)
    assert mixing.source_targets({}) == {}


def test_flow_repeats_only_what_single_passes_cannot_fill():
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 4}
    flow = mixing.route(capacity, {"a": 12, "b": 12})
    into = lambda s: sum(n for (p, x), n in flow.items() if x == s)
    used = {p: sum(n for (q, _), n in flow.items() if q == p) for p in capacity}
    assert into("a") == 12 and into("b") == 12
    assert all(used[p] <= capacity[p] for p in capacity)  # 24 words are there, so nothing repeats
    flow = mixing.route({("a",): 5, ("a", "b"): 5}, {"a": 9, "b": 6})
    assert sum(flow.values()) == 15 and max(flow[(("a",), "a")], 0) <= 10


def test_flow_is_the_cheapest_of_all(spark):
    """Random small networks against every split of every pattern: most words, then fewest repeats."""
    rng = random.Random(17)
    for _ in range(40):
        names = ["a", "b", "c"][: rng.randint(1, 3)]
        pool = [p for n in range(1, len(names) + 1) for p in itertools.combinations(names, n)]
        capacity = {p: rng.randint(0, 3) for p in rng.sample(pool, min(len(pool), 3))}
        quota = {s: rng.randint(0, 5) for s in names}
        splits = [[x for x in itertools.product(range(2 * n + 1), repeat=len(p)) if sum(x) <= 2 * n] for p, n in capacity.items()]
        best = (0, 0)
        for pick in itertools.product(*splits):
            into = Counter()
            for p, x in zip(capacity, pick, strict=True):
                into.update(dict(zip(p, x, strict=True)))
            if all(into[s] <= quota[s] for s in names):
                repeats = sum(max(0, sum(x) - n) for x, n in zip(pick, capacity.values(), strict=True))
                best = max(best, (sum(into.values()), -repeats))
        flow = mixing.route(capacity, quota)
        used = {p: sum(n for (q, _), n in flow.items() if q == p) for p in capacity}
        assert (sum(flow.values()), -sum(max(0, used[p] - capacity[p]) for p in capacity)) == best
        assert all(used[p] <= 2 * capacity[p] for p in capacity)


def test_mix_of_overlapping_sources(spark):
    """A document of two sources serves the one that its own documents can't fill."""
    rng = random.Random(18)
    rows = [(i, "w " * rng.randint(1, 20), ["a"] if i % 10 else ["a", "b"]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at array<string>")
    out = mixing.mix(df, F.col("at")).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(5), F.col("at")).collect()}
    assert len(out) == 600 and again == {r.doc_id: r.taken for r in out} and all(r.taken <= 2 * r.size for r in out)
    total = {s: sum(r.size for r in out if s in r.at) for s in "ab"}
    want = sum(min(t, 2 * total[s]) for s, t in mixing.source_targets(total).items())
    assert abs(sum(r.taken for r in out) - min(want, 2 * sum(r.size for r in out))) <= 45


def test_repeated_ids_are_taken_alike(spark):
    rows = [(i % 7, "w " * (i % 5 + 1), "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [Counter((r.doc_id, r.size, r.taken) for r in mixing.mix_by_source(df.repartition(n)).collect()) for n in (1, 3, 6)]
    assert runs[0] == runs[1] == runs[2]


def test_mix_takes_near_its_targets(spark):
    rng = random.Random(8)
    source = {i: rng.choice(["a", "a", "a", "b", "c", None]) for i in range(400)}
    texts = ["w " * rng.randint(0, 20) for _ in range(400)] + [None]
    rows = mixing.mix_by_source(frame(spark, texts, source=source)).collect()
    again = {r.doc_id: r.taken for r in mixing.mix_by_source(frame(spark, texts, source=source).repartition(7)).collect()}
    assert len(rows) == 401 and again == {r.doc_id: r.taken for r in rows} and rows[0].kept == "x"
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 21
        assert all(0 <= r.taken <= 2 * r.size for r in own) and own[0].source_size == sum(r.size for r in own)
    assert mixing.mix_by_source(frame(spark, [])).count() == 0


QUESTION = "Alice has 12 apples and gives 5 apples to Bob, how many apples does Alice have left in the basket after 3 days?"


def test_decontamination(spark):
    changed = "xx yy. Mary has 31 apples and gives 7 apples to John, how many apples does Mary have left in the basket after 9 days? zz"
    mixed = "Mary has 31 apples and gives 7 apples to John, how many apples does Steve have left in the basket after 90 weeks"
    texts = ["filler " * 40 + QUESTION + " more", changed, QUESTION.upper(), mixed, None, "", "just some words about apples and how many apples there are", " ".join(QUESTION.split()[:8])]
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, "ab c"), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert {0, 1, 2} <= set(got) and not {4, 5, 6, 7} & set(got) and got[1].slot_consistency == 1.0
    assert {r.doc_id for r in decontaminate.clean(frame(spark, texts), bench).collect()} == set(range(8)) - set(got)
    assert decontaminate.contaminated(frame(spark, texts), bench.limit(0)).count() == 0 and decontaminate.contaminated(frame(spark, []), bench).count() == 0


def test_inconsistent_slots_are_no_match(spark):
    bench = spark.createDataFrame([(1, "Anna pays Bert what Anna owes and Bert thanks Anna for what Anna and Bert did")], "item_id long, text string")
    texts = ["Carl pays Dora what Carl owes and Dora thanks Carl for what Carl and Dora did", "Carl pays Dora what Emil owes and Fred thanks Gina for what Hans and Ines did"]
    assert [r.doc_id for r in decontaminate.contaminated(frame(spark, texts), bench).collect()] == [0]


def test_items_of_figures_and_short_items_are_found_literally(spark):
    items = ["What is 3 + 4 - 5?", "12 30 kg 7 m 19 22 5 cm 81 4 66", "Define entropy", "Alice Bob Carol Dave sing together in the old town hall every evening"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    renamed = "Emma Finn Gina Hugo sing together in the old town hall every evening"
    texts = [f"before {t} after" for t in [*items, renamed]] + ["What is 3 + 4 - 6?", "12 30 kg 7 m 19 23 5 cm 80 4 67", "define the entropy"]
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert got == {(0, 0): 1, (1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 3): 1}
    assert {r.doc_id for r in decontaminate.clean(frame(spark, texts), bench).collect()} == {5, 6, 7}


def test_a_passage_of_a_long_item_is_found(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [" ".join(["x", *words[40:100], "y"]), " ".join(words[5:18]), " ".join(words[5:17]), " ".join([*words[5:17], "z", *words[60:72]])]
    got = {r.doc_id: r for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert set(got) == {0, 1} and got[0].coverage < decontaminate.COVERAGE
    assert {r.doc_id for r in decontaminate.clean(frame(spark, texts), bench).collect()} == {2, 3}


def test_item_ids_of_any_type_null_and_repeated(spark):
    items = [("x", QUESTION), (None, QUESTION), ("x", QUESTION), ("y", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = frame(spark, [f"a b {QUESTION}", "nothing here"])
    got = decontaminate.contaminated(docs.unionByName(docs), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == {(0, "x"): 4, (0, None): 2}


def brute_decontaminate(texts, items):
    """The rules in plain Python, from the words on; tokens in ASCII."""
    units = set(decontaminate.UNITS)

    def canon(t):
        out = []
        for w in words_of(t):
            w = re.sub("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", w.decode())
            if w:
                low = w.lower()
                kind = "#n" if w[0].isdigit() else "#u" if low in units else "#t" if w[0].isupper() and (len(w) == 1 or re.search("[a-z]", w[1:])) else None
                out.append((low, kind))
        return out

    def windows(toks, width):
        found = {}
        for p in range(len(toks) - width + 1):
            w = toks[p : p + width]
            for form, slots in ((0, ("#n", "#u", "#t")), (1, ("#n", "#u"))):
                if width >= decontaminate.SHORTEST and sum(k in slots for _, k in w) <= width / 2:
                    found.setdefault((form, tuple(k if k in slots else v for v, k in w)), []).append(p)
            if width < decontaminate.SHORTEST or sum(k in ("#n", "#u") for _, k in w) > width / 2:
                found.setdefault((2, tuple(v for v, _ in w)), []).append(p)
        return found

    out = set()
    for j, item in enumerate(items):
        it = canon(item)
        width = min(decontaminate.WINDOW, len(it))
        if not width:
            continue
        mine = windows(it, width)
        total = [sum(len(ps) for (f, _), ps in mine.items() if f == k) for k in range(3)]
        for i, text in enumerate(texts):
            doc = canon(text)
            theirs = windows(doc, width)
            met = [(f, p, a) for key, ps in mine.items() for a in theirs.get(key, ()) for p in ps for f in [key[0]]]
            places = lambda *fs: len({p for f, p, _ in met if f in fs})  # noqa: E731, B023
            shares = [n / of for n, of in ((places(0), total[0]), (places(0, 1), total[1]), (places(0, 1, 2), total[1] + total[2])) if of]
            cells = {(p - a, p + k): (it[p + k], doc[a + k]) for _, p, a in met for k in range(width)}
            by_copy = {}
            for (shift, _), (m, d) in cells.items():
                if m[1]:
                    by_copy.setdefault(shift, {}).setdefault(m[0], Counter())[d[0]] += 1
            same = max((sum(max(c.values()) for c in u.values()) / sum(sum(c.values()) for c in u.values()) for u in by_copy.values()), default=1.0)
            run = max((len(list(g)) for s in {s for s, _ in cells} for _, g in itertools.groupby(enumerate(sorted(k for z, k in cells if z == s and cells[z, k][0][0] == cells[z, k][1][0])), lambda x: x[1] - x[0])), default=0)
            if (max(shares, default=0) >= decontaminate.COVERAGE and same >= decontaminate.CONSISTENT) or run >= decontaminate.RUN:
                out.add((i, j))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(21)
    names = ["Anna", "Bert", "Carl", "Dora", "Emil"]
    word = lambda: rng.choice([rng.choice(WORDS[:12]), rng.choice(WORDS[:12]), rng.choice(names), str(rng.randint(1, 9)), rng.choice(["kg", "days"])])
    items = [" ".join(word() for _ in range(rng.choice([2, 5, 9, 14, 30]))) for _ in range(25)]
    texts = []
    for _ in range(60):
        parts = [word() for _ in range(rng.randint(0, 20))]
        it = rng.choice(items).split()
        a = rng.randint(0, len(it) // 2)
        piece = it[a:] if rng.random() < 0.4 else it
        swap = dict(zip(names, rng.sample(names, 5), strict=True)) if rng.random() < 0.5 else {}
        piece = [swap.get(w, str(rng.randint(1, 9)) if w.isdigit() and rng.random() < 0.3 else w) for w in piece]
        if rng.random() < 0.3:
            piece[rng.randrange(len(piece))] = word()
        texts.append(" ".join(parts + piece + [word() for _ in range(rng.randint(0, 5))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    want = brute_decontaminate(texts, items)
    assert got == want and len(want) > 30


def test_quality_classifier(spark):
    rng = random.Random(10)
    good = [" ".join(rng.choices(WORDS, k=rng.randint(5, 60))) + "." for _ in range(200)]
    bad = [" ".join(f"{w}%%%" for w in rng.choices(WORDS, k=rng.randint(5, 60))) for _ in range(60)]
    texts = good + bad + [None, ""]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(i, 0, 0) for i in range(200, 230)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    model = pu_quality.fit(*pu_quality.training_rows(frame(spark, texts), labels, F.lit(True)))
    rows = {r.doc_id: r.score for r in pu_quality.score_documents(frame(spark, texts), model, "doc_id").collect()}
    assert len(rows) == 262 and all(0 <= s <= 1 for s in rows.values())
    assert np.mean([rows[i] >= 0.3 for i in range(1, 200, 2)]) > 0.95 and np.mean([rows[i] < 0.3 for i in range(200, 260)]) > 0.95
    assert 0.5 < model.prior < 0.95
    empty = pu_quality.fit(*pu_quality.training_rows(frame(spark, texts), labels.limit(0), F.lit(True)))
    assert {r.score for r in pu_quality.score_documents(frame(spark, texts), empty, "doc_id").collect()} == {0.5}


def test_risk_is_least_where_the_classifier_ends():
    """The non-negative risk by plain sums: lower than at the start, and not lowered by steps along any input."""
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(1, 1, (60, 2)), rng.normal(0, 1, (60, 2))], axis=1).astype(np.float32)
    u = np.concatenate([rng.normal(0, 1.5, (200, 2)), rng.normal(0, 1, (200, 2))], axis=1).astype(np.float32)
    prior = 0.4

    def risk(w, b):
        loss = lambda rows, sign: sum(math.log1p(math.exp(-sign * (sum(float(x) * float(y) for x, y in zip(r, w, strict=True)) + b))) for r in rows) / len(rows)
        negative = loss(u, -1) - prior * loss(p, -1)
        return prior * loss(p, 1) + max(0.0, negative) + pu_quality.DECAY / 2 * sum(float(x) ** 2 for x in w)

    w, b = pu_quality.nnpu(p, u, prior)
    least = risk(w, b)
    assert least < risk(np.zeros(4), 0.0) - 0.05
    for k in range(4):
        for step in (-0.1, 0.1):
            moved = w.copy()
            moved[k] += step
            assert risk(moved, b) > least - 1e-4
    assert all(risk(w, b + step) > least - 1e-4 for step in (-0.1, 0.1))


def brute_licenses(files):
    """Cosines of all units with all templates, by plain sums; ``(license, origin)`` of each path."""
    tokens = lambda t: re.findall("[a-z0-9]+(?:[.][0-9]+)*", t.lower())
    templates = [*((n, t, False) for n, t in licenses.TEMPLATES), *((n, t, True) for n, t in licenses.TITLES)]
    vocabulary = {t for _, x, _ in templates for t in tokens(x)}
    found = Counter(t for _, text in files for t in set(tokens(text or "")) & vocabulary)
    idf = {t: math.log((len(files) + 1) / (found[t] + 1)) + 1 for t in vocabulary}
    # The mean is over distinct terms.
    other = sum(idf.values()) / len(idf)

    def vector(text):
        v = {t: (1 + math.log(n)) * idf.get(t, other) for t, n in Counter(tokens(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    known = [(n, vector(x), title) for n, x, title in templates]
    own = {}
    for path, text in files:
        bare = re.sub("^[^A-Za-z0-9]+", "", text or "")
        units = [(0, i, x) for i, x in enumerate(bare.split("\n"))]
        units += [(1, i, x) for i, x in enumerate(re.split("\n(?:[^A-Za-z0-9\n]*\n)+", bare)) if "\n" in x]
        units += [(2, 0, bare)] if "\n" in bare else []
        hits = []
        for kind, no, x in units:
            v = vector(x) if tokens(x) else {}
            for wanted in (False, True):
                best = max(((round(sum(v.get(t, 0) * w for t, w in u.items()), 9), -k, name) for k, (name, u, title) in enumerate(known) if title == wanted), default=(0, 0, None))
                if best[0] >= licenses.MIN_COSINE and (not wanted or (no == 0 and kind < 2)):
                    hits.append((best[0], -no, -kind, best[2], len(words_of(x)), wanted))
        if hits:
            most = max(sum(h[4] for h in hits if h[2] == -k and not h[5]) for k in (0, 1))
            own[path] = (max(hits)[3], any(h[5] or h[2] == -2 for h in hits) or 2 * most >= len(words_of(text)))
    votes = Counter((p.rsplit("/", 1)[0], name) for p, (name, whole) in own.items() if whole)
    out = {}
    for path, _ in files:
        if path in own:
            out[path] = (own[path][0], "own")
            continue
        at = path
        while "/" in at:
            at = at.rsplit("/", 1)[0]
            here = {name: n for (d, name), n in votes.items() if d == at}
            if here:
                out[path] = (min(name for name, n in here.items() if n == max(here.values())), "inherited")
                break
        else:
            out[path] = (None, None)
    return out


def test_licence_files_and_source_headers(spark):
    mit = dict(licenses.TEMPLATES[19:20])["MIT"]
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    body = " ".join(f"clause{i % 97} of the terms" for i in range(3000))
    gpl = [t for n, t in licenses.TEMPLATES if n == "GPL-3.0"][-1]
    header = "/*\n * tool - does things\n *\n * Copyright (C) 2020 A. Person\n *\n" + "\n".join(" * " + gpl[i : i + 60] for i in range(0, len(gpl), 60)) + "\n */\n" + "int main() { return 0; }\n" * 40
    files = [
        ("/a/LICENSE", "MIT License\n\nCopyright (c) 2024 Someone\n\n" + wrapped), ("/a/x.py", "print(1)"),
        ("/b/LICENSE", "\n    Apache License\n    Version 2.0, January 2004\n    http://www.apache.org/licenses/\n\n" + body), ("/b/deep/er/y.py", "print(2)"),
        ("/c/COPYING", "   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + body), ("/c/z.c", "int x;"),
        ("/d/main.c", header), ("/d/other.c", "int y;"),
        ("/e/LICENSE", mit), ("/e/w.py", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got == brute_licenses(files)
    assert got["/a/x.py"] == ("MIT", "inherited") and got["/b/deep/er/y.py"] == ("Apache-2.0", "inherited") and got["/c/z.c"] == ("GPL-3.0", "inherited")
    assert got["/d/main.c"] == ("GPL-3.0", "own") and got["/d/other.c"] == (None, None) and got["/e/w.py"] == ("MIT", "inherited")


def test_licenses_equal_brute_force(spark):
    rng = random.Random(11)
    notes = [t for _, t in licenses.TEMPLATES]
    files = [("/p/LICENSE", "Released under the MIT License."), ("/p/a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("/p/a/b/c/x", "code here"), ("/p/a/y", None), ("/q/z", ""), ("/q/w", "free the general version of the license under public")]
    for i in range(40):
        lines = [" ".join(rng.choices([*WORDS, "license", "under", "the", "public"], k=8)) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), rng.choice(notes) + rng.choice(["", " ok", " and many more words than that"]))
        files.append((f"/r/{rng.choice('abc')}/{i}", "\n".join(lines)))
    df = spark.createDataFrame([(i, p, t, "c") for i, (p, t) in enumerate(files)], "doc_id long, path string, text string, line string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got == brute_licenses(files)
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df.unionByName(df)).count() == 2 * len(files)


def test_pipeline_drops_copies_by_row(spark):
    import corpus_pipeline

    copy, other = " ".join(WORDS), " ".join(reversed(WORDS))
    rows = [(1, copy), (1, copy), (None, copy), (None, copy), (2, copy), (2, other), (None, "a text of its own"), (3, None)]
    df = spark.createDataFrame([(i, t, None, None, None, "x", 7) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert Counter(got) == Counter([(1, copy), (2, other), (None, "a text of its own"), (3, None)])


def test_pipeline(spark):
    import os

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    all_texts = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == docs.columns
    kept = kept.cache()
    assert all(re.search("[^\\W\\d_]", r.text) for r in kept.collect())
    stage2 = corpus_pipeline.near_duplicates(spark, kept, folder).cache()
    texts = [r.text for r in kept.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in kept.orderBy("doc_id").collect()]
    assert sorted(r.doc_id for r in stage2.collect()) == [ids[i] for i, (_, c) in enumerate(brute_groups(texts, 5)) if c == i]
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in stage2.collect()} and all(r.taken > 0 for r in out)
    assert all("<EMAIL>" in r.text or r.text == all_texts[r.doc_id] or "<" in r.text for r in out)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, letter int, raw string, row_key int, place int, _t string, _spans int, _doc int, _u int, _k int, size int, taken int, kept int, node int, doc_key int"


def test_stages_keep_columns_of_any_name_and_all_rows(spark):
    import corpus_pipeline

    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=30)) for _ in range(12)] + ["mail a@b.co " + " ".join(WORDS), None, ""]
    rows = [(i, x, "en", "s", len(x or ""), 0.5, "zz", 1, "r", 2, 3, "secret a@b.co", 4, 5, 6, 7, 8, 9, 10, 11, 12) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, CLASHING)
    folder = "/root/testdata/sf0.001"
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.personal_data):
        if stage is corpus_pipeline.decontamination and not __import__("os").path.isdir(folder):
            continue
        out = stage(spark, df, folder)
        assert out.columns == df.columns
        got = {r.doc_id: r for r in out.collect()}
        assert set(range(13)) <= set(got), stage
        assert all(r[5:] == rows[i][5:] for i, r in got.items()), stage
        assert stage(spark, df.limit(0), folder).count() == 0
    assert "<EMAIL>" in {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, df, "").collect()}[12]
    mixed = corpus_pipeline.source_mix(spark, df, "")
    assert {"_u", "_k", "_doc", "score", "target"} <= set(mixed.columns) and all(r["_u"] == 6 for r in mixed.collect())


QUERIES = ["op1_quality_rules", "op2_pii", "op3_licenses", "op4_minhash", "op5_language_id", "op6_url_filters", "op7_suffix_tree", "op8_mixing", "op9_decontamination", "op10_pu_quality", "pipeline"]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Tables without rows, and tables with nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    rng = random.Random(40)
    folder = tmp_path_factory.mktemp("tables")
    texts = [None, "", " ", "a", "!", "w" * 40_000, "word " * 9000, QUESTION, "Released under the MIT License.", "mail a@b.co"] + [" ".join(rng.choices(WORDS, k=40)) for _ in range(20)]
    docs = [(i if i % 11 else None, x, rng.choice(["aa", "bb", None]), rng.choice(["s", "t", None]), None if i % 3 else 7, "x", 1, "k", 2, 3, 4) for i, x in enumerate(texts)]
    docs += docs[:12] + [(5, texts[-1], "aa", "s", 1, "y", 1, "k", 2, 3, 4)] * 2
    kinds = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long, path string, size int, kept string, node int, score int, hub int"),
        "benchmark": ([(1, QUESTION, 0), (None, QUESTION, 0), (2, None, 0), (3, "", 0), (1, QUESTION, 0)], "item_id long, text string, doc int"),
        "labels": ([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int"),
        "pages": ([(1, "http://a.com/x", "h"), (1, "http://a.com/x", "h"), (None, None, None), (2, "", ""), (3, "http://" + "a" * 30_000 + ".net/es/", "")], "page_id long, url string, html string"),
    }
    for name, (rows, schema) in kinds.items():
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(str(folder / "odd" / f"{name}.parquet"))
        df.limit(0).write.parquet(str(folder / "empty" / f"{name}.parquet"))
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_queries_on_odd_and_empty_tables(spark, odd_tables, name):
    import __spark_entry__ as entry

    query = entry.queries()[name]
    assert query(spark, str(odd_tables / "empty")).count() == 0
    rows = query(spark, str(odd_tables / "odd")).collect()
    n = spark.read.parquet(str(odd_tables / "odd" / ("pages.parquet" if "url" in name else "documents.parquet"))).count()
    if name == "pipeline":
        assert rows and len({r.text for r in rows}) == len(rows) and not any(QUESTION in r.text for r in rows)
    elif "decontam" in name:
        assert Counter(r.item_id for r in rows) == {1: 4, None: 2}
    else:
        assert len(rows) == n
        by = {}
        for r in rows:
            d = r.asDict()
            by.setdefault(d.get("doc_id", d.get("page_id")), []).append(r)
        assert None in by


def test_import_guard_is_in_the_entry_alone():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sum(k.startswith("op") for k in entry.queries()) == 10
