"""Text operators against brute force, and their defined results for odd input."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.llm import bpe, decontaminate, html, licenses, pii, quality, repeats, sharding, simhash, toxicity
from mirrortab.llm.graph import components

LOWER = {b: b + 32 for b in range(65, 91)}
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, n_words int, found string, contamination string, block int"


def docs(spark, texts):
    """Texts with ids, and extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in enumerate(texts)], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


WORDS = [f"w{i}" for i in range(40)]


def random_texts(seed, n, longest=60):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, longest))) for _ in range(n)]


# licences

def test_license_scan_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = "mit license Apache LICENSE general public the é of Licensed under".split()
    texts = [" ".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(80)] + [None, "", "MIT-License mit license", "x " * 60_000]
    got = by_id(licenses.license_scan(docs(spark, texts)), "license")
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOWER))
        at = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i][0]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_spans_bridge_a_changed_word(spark):
    text = "before " + licenses.TEMPLATES[0][1].replace("free of charge", "at no charge") + " after"
    r = licenses.license_scan(docs(spark, [text])).first()["license"]
    assert r.labels == "mit" and r.n_base == 0 and r.score > 0.8
    assert [(s.label, s.first) for s in r.spans] == [("mit", 1)]


def test_bare_license_names(spark):
    names = {"CC BY 4.0": "cc-by", "CC BY-SA 4.0": "cc-by-sa", "CC BY-NC 4.0": "cc-by-nc"}
    texts = [before + name for before in ("License: ", "Licensed under ", "") for name in names] + ["sent cc by mail 4 0"]
    got = by_id(licenses.license_scan(docs(spark, texts)), "license")
    assert [got[i][0].labels for i in range(len(texts))] == list(names.values()) * 3 + [""]
    assert all(r.n_base == 0 for r, in got.values())


# near-duplicates

def components_by_brute_force(fps, ids):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = collections.defaultdict(lambda: float("inf"))
    for g, i in zip(group, ids):
        least[g] = min(least[g], i)
    return [least[g] for g in group]


def test_simhash_equals_brute_force(spark):
    texts = random_texts(5, 60, 300)
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[:30]] + texts[:5] + [None, "", "  \t", "One two", "one two"]
    got = by_id(simhash.near_duplicates(docs(spark, texts)), "fingerprint", "component_id")
    fps = [int(got[i][0], 16) for i in range(len(texts))]
    for t, f in zip(texts, fps):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [simhash.xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        assert f == sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    assert [got[i][1] for i in range(len(texts))] == components_by_brute_force(fps, range(len(texts)))


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.int64)
    flips = [(int(b), int(b) ^ sum(1 << int(x) for x in rng.choice(63, d, replace=False))) for b in base for d in (1, 2, 3, 4, 5, 6)]
    fps = sorted({x for pair in flips for x in pair})
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.linked(df, len(fps))).collect()}
    want = components_by_brute_force([x & (2**64 - 1) for x in fps], fps)
    assert [roots.get(x, x) for x in fps] == want


def test_near_dedup_keeps_one_of_each_group(spark):
    base = " ".join(WORDS * 3)
    texts = [base, base, "alone in the world of words", None, None, ""]
    df = docs(spark, texts).unionByName(docs(spark, texts))
    out = simhash.near_deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3]
    nameless = df.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert simhash.near_deduplicated(nameless).count() == 3


# contamination

def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    items = random_texts(2, 12, 40) + ["w1 w2", None, "", "…!"]
    texts = random_texts(3, 30) + [" ".join((random_texts(i, 1)[0], items[i % 12], random_texts(i + 1, 1)[0])) for i in range(20)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    got = by_id(decontaminate.report(docs(spark, texts), bench), "n_words", "n_hit", "items_sha256", "contaminated")
    for i, t in enumerate(texts):
        w, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for k, item in enumerate(items):
            x = WORD.findall((item or "").translate(LOWER))
            n = min(13, len(x))
            grams = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in grams:
                    hit.update(range(a, a + n))
                    found.add(str(k))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert got[i] == (len(w), len(hit), sha, bool(hit) and 20 * len(hit) >= len(w))
    del rng


def test_contamination_in_several_blocks(spark, monkeypatch):
    items, texts = random_texts(2, 30, 60), random_texts(3, 20) + random_texts(2, 30, 60)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    once = decontaminate.report(docs(spark, texts), bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1_000)
    assert sorted(decontaminate.report(docs(spark, texts), bench).collect()) == sorted(once)


def test_decontaminate_documents_and_spans(spark):
    item = " ".join(WORDS[:15])
    texts = ["start " + item.upper() + " end", "clean text", None]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.decontaminate(docs(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == docs(spark, []).columns
    cut = by_id(decontaminate.decontaminate(docs(spark, texts), bench, "spans"), "text")
    assert cut[0] == ("start  end",) and cut[1] == ("clean text",) and cut[2] == (None,)
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs(spark, texts), bench, "all")


def test_repeated_items_are_one_and_blocks_are_bounded(spark):
    item = " ".join(f"i{j}" for j in range(40))
    bench = spark.createDataFrame([(7, item)] * 500 + [(i, item + f" x{i}") for i in range(30)], "item_id bigint, text string")
    blocks = [b.value for b in decontaminate.benchmark_blocks(bench, 500)]
    assert sum(map(len, blocks)) == 31 and max(sum(len(w) for _, w in b) for b in blocks) <= 500 + len(item) + 4
    assert [len(b.value) for b in decontaminate.benchmark_blocks(bench)] == [31]
    assert [b.value for b in decontaminate.benchmark_blocks(bench.where("false"))] == [[]]


# toxicity

def test_toxicity_learns_and_leaves_mentions_alone(spark):
    rng = np.random.default_rng(4)
    fill = lambda: " ".join(rng.choice(WORDS, 12))
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        # in the sample, one group is mentioned beside insults far more often
        rows.append((i, f"{fill()} {'muslims ' if toxic or i % 12 == 1 else ''}{'idiot ' if toxic else ''}{fill()}", int(toxic)))
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    fair, plain = toxicity.train(texts, labels), toxicity.train(texts, labels, fairness=0.0)
    assert fair.score("an idiot speaks") > 0.5 > fair.score("a walk with muslims in the park")
    assert fair.score("muslims in the park") - fair.score("in the park") < plain.score("muslims in the park") - plain.score("in the park")
    held = [(fair.score(t), x) for i, t, x in rows if by_crc(i)]
    assert all((s >= 0.5) == bool(x) for s, x in held)
    scored = toxicity.scored(docs(spark, [None, "", "idiot " * 50_000]), fair)
    got = by_id(scored, "toxicity")
    assert got[0] == got[1] and got[2][0] > 0.5


def by_crc(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(docs(spark, ["a"]), none).score("a") < 0.5


# repeated spans

def spans_by_brute_force(texts, k=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + k] for b in data for i in range(len(b) - k + 1))
    out = []
    for b in data:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                covered[i : i + k] = True
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out.append((len(b), int(covered.sum()), int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_spans_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("abcdefg hij"), 3000))
    texts = [
        "a" * 1000, "a" * 399, "a" * 400, "xy" * 700, base, base[100:600] + "Q" + base[700:1200], base[:450], "é" * 500, "", None,
        base, base[1000:1400], "z" * 401, base[2000:2399], "q" + base[500:1500] + "r" + base[1400:2000],
    ]
    want = spans_by_brute_force(texts)
    for group in (repeats.GROUP, 2, 1):  # smaller groups are split, down to whole windows
        found = repeats.repeats(docs(spark, texts), group)
        got = {r.doc_id: (r.n_bytes, sum(s.end - s.first for s in r.spans), len(r.spans), r.kept_sha256) for r in found.collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_repeated_spans_of_a_very_long_text(spark):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcd "), 900))
    long = base + "".join(rng.choice(list("xyz "), repeats.CHUNK + 50_000)) + base[100:800]
    texts = [long, base[200:700], "short"]
    got = {r.doc_id: [(s.first, s.end) for s in r.spans] for r in repeats.repeats(docs(spark, texts)).collect()}
    assert got == {0: [(100, 800), (len(long) - 700, len(long))], 1: [(0, 500)], 2: []}


def test_windows_are_compared_by_their_bytes():
    """Groups are formed by hashes; whatever is in a group, only windows of equal bytes are repeated."""
    rng = np.random.default_rng(7)
    anchor = bytes(rng.integers(0, 256, repeats.GRAM, dtype=np.uint8))
    reach = repeats.THRESHOLD - repeats.GRAM
    for _ in range(150):
        pool = [bytes(rng.integers(0, 2, reach, dtype=np.uint8)) for _ in range(2)]
        pieces, ats = [], []
        for _ in range(int(rng.integers(1, 7))):
            left, right = bytearray(pool[rng.integers(2)]), bytearray(pool[rng.integers(2)])
            for side in (left, right):
                if rng.random() < 0.7:
                    side[rng.integers(reach)] ^= 1
            middle = anchor if rng.random() < 0.8 else anchor[:-1] + b"?"  # as if their hashes were equal
            high = int(rng.integers(0, reach + 1))
            low = int(rng.integers(0, high + 1))
            pieces.append(bytes(left[reach - high :]) + middle + bytes(right[: reach - low]))
            ats.append(high)
        seen = collections.Counter((at - i, p[i : i + 400]) for p, at in zip(pieces, ats) for i in range(len(p) - 399))
        want = {(r, i) for r, (p, at) in enumerate(zip(pieces, ats)) for i in range(len(p) - 399) if seen[at - i, p[i : i + 400]] > 1}
        assert {(r, i) for r, a, b in repeats.repeated_windows(pieces, ats) for i in range(a, b + 1)} == want


def test_runs_of_long_texts_join_up():
    data = np.random.default_rng(2).integers(97, 101, repeats.CHUNK + 5000).astype(np.uint8)
    _, _, first, last = repeats.runs(data)
    assert first[0] == 0 and last[-1] == len(data) - repeats.THRESHOLD and (first[1:] == last[:-1] + 1).all()


# personal data

def test_pseudonyms(spark):
    texts = [
        "card 4111111111111111, again 4111111111111111; bad 4111111111111112", "mail a.person7@example.com or 10.0.0.255 or 10.0.0.256",
        "+1 (456) 555-2186 4111 1111 1111 1111", "1999-12-31 31/12/1999 99/99/1999 ssn 123-45-6789 000-12-3456", None, "", "plain",
        "x" * 200_000 + "1" * 200_000, "token = \"0641917ea4e9feb9\"",
    ]
    got = {i: t for i, (t, _) in by_id(pii.pseudonymised(docs(spark, texts), "k", found="n"), "text", "n").items()}
    a, b, bad = re.findall(r"\d{16}", got[0])
    luhn = lambda n: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(n))) % 10 == 0
    assert a == b != "4111111111111111" and luhn(a) and bad == "4111111111111112"
    assert re.fullmatch(r"mail [a-z]\.[a-z]{6}\d@example\.com or (\d+\.){3}\d+ or 10\.0\.0\.256", got[1]) and "a.person7" not in got[1]
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} 4\d{3}( \d{4}){3}", got[2]) and luhn(re.sub(r"\D", "", got[2].split(" ", 3)[3]))
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d/\d\d/\d{4} 99/99/1999 ssn \d{3}-\d\d-\d{4} 000-12-3456", got[3]) and "1999-12-31" not in got[3]
    assert (got[4], got[5], got[6], got[7]) == (None, "", "plain", texts[7])
    other = by_id(pii.pseudonymised(docs(spark, texts), "other key"), "text")
    assert other[0][0] != got[0]


def feistel(values, radices, tweak, key):
    """The permutation in plain Python."""
    v = list(values)
    cut = len(v) // 2
    for r in range(1, 9):
        mine, other = (range(cut), v[cut:]) if r % 2 else (range(cut, len(v)), v[:cut])
        said = "|".join([key, tweak, str(r), ",".join(map(str, other))])
        noise = "".join(hashlib.sha512(f"{said}|{i}".encode()).hexdigest() for i in (0, 1))
        v = [(x + int(noise[6 * (i - mine[0]) : 6 * (i - mine[0]) + 6], 16)) % radices[i] if i in mine else x for i, x in enumerate(v)]
    return v


def permuted_text(text, tweak, key):
    """Letters and digits of a text among themselves, each kind staying its kind."""
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    base = lambda c: ord("0") if c.isdigit() else ord("a") if c.islower() else ord("A")
    new = feistel([ord(text[i]) - base(text[i]) for i in at], [10 if text[i].isdigit() else 26 for i in at], tweak, key)
    out = list(text)
    for i, v in zip(at, new):
        out[i] = chr(base(text[i]) + v)
    return "".join(out)


def iban_valid(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_pseudonyms_equal_an_independent_feistel(spark):
    import ipaddress

    secrets = ["p@ssw0rd!x9", "hunter2!zz9", "eyJhbGciOi.J9_x-y==", "Tr0ub4dor&3,x"]
    texts = [f"password: {secrets[0]} and", f'"token": "{secrets[1]}" and', f"token={secrets[2]}", f"pwd = '{secrets[3]}' and",
             "Authorization: Bearer abcdefGHIJ0123456789.x-y rest", "from 10.20.30.40 to 255.0.0.1", "ssn 123-45-6789",
             "2001:db8::8a2e:370:7334 and 2001:0db8:0000:0000:0000:8a2e:0370:7334 at 12:30:45 or std::vector ::1 a::b 2024-02-03",
             "pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 not DE88370400440532013000"]
    got = by_id(pii.pseudonymised(docs(spark, texts), "k", found="n"), "text", "n")
    heads = ["password: ", '"token": "', "token=", "pwd = '", "Authorization: Bearer "]
    for i, (head, secret) in enumerate(zip(heads, [*secrets, "abcdefGHIJ0123456789.x-y"])):
        assert got[i] == (texts[i].replace(secret, permuted_text(secret, "secret", "k")), 1)
        assert got[i][0].startswith(head)
    address = lambda x: ".".join(map(str, feistel(map(int, x.split(".")), [256] * 4, "ipv4", "k")))
    assert got[5] == (f"from {address('10.20.30.40')} to {address('255.0.0.1')}", 2)
    area, group, serial = feistel([122, 44, 6788], [898, 99, 9999], "ssn", "k")
    assert got[6] == (f"ssn {area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}", 1)
    words = got[7][0].split()
    whole = [int(g, 16) for g in ipaddress.ip_address("2001:db8::8a2e:370:7334").exploded.split(":")]
    assert words[0] == words[2] == ":".join(f"{g:x}" for g in feistel(whole, [65_536] * 8, "ipv6", "k"))
    assert words[3:9] == ["at", "12:30:45", "or", "std::vector", "::1", "a::b"]
    assert words[-1] != "2024-02-03" and re.fullmatch(r"\d{4}-\d\d-\d\d", words[-1])
    a, b = got[8][0][4:31], got[8][0].split()[8]
    assert iban_valid(a) and iban_valid(b) and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", a) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", b)
    assert a != texts[8][4:31] and b != "GB82WEST12345698765432" and got[8][0].endswith("not DE88370400440532013000")


def test_phone_numbers_of_any_area(spark):
    forms = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1-132-155-1352", "+1.456.055.2186", "+14565552186", "555-123-4567", "(555) 123-4567", "(017)555-7713", "1-555-123-4567", "555.123.4567"]
    kept = ["12-555-123-4567", "555-123-45678", "+1 (456) 555-21864", "123-45-678", "5551234567"]
    got = by_id(pii.pseudonymised(docs(spark, [f"call {x}, now" for x in forms + kept]), "k", found="n"), "text", "n")
    low = lambda x: [c < "2" for c in (x[0], x[3])]
    new = {}
    for i, x in enumerate(forms):
        text, n = got[i]
        y = text[5:-5]
        a, b = re.sub(r"\D", "", x)[-10:], re.sub(r"\D", "", y)[-10:]
        assert n == 1 and text != f"call {x}, now" and re.sub(r"\d", "0", text) == re.sub(r"\d", "0", f"call {x}, now")
        assert low(a) == low(b) and new.setdefault(a, b) == b and y.startswith(re.match(r"\+1|1-|", x)[0])
    assert len(set(new.values())) == len(new)
    assert [got[len(forms) + i] for i in range(len(kept))] == [(f"call {x}, now", 0) for x in kept]


def test_phone_numbers_never_share_a_pseudonym(spark):
    texts = [f"+1 ({a:03d}) {e}55-0000" for a in range(0, 1000, 7) for e in range(10)]
    out = by_id(pii.pseudonymised(docs(spark, texts), "k"), "text")
    assert len(set(out.values())) == len(texts) and not set(texts) <= {t for t, in out.values()}


def test_secrets_of_any_length_and_quoted_keys(spark):
    rng = np.random.default_rng(11)
    secret = lambda n: "".join(rng.choice(list("abcXYZ0189_.-/+"), n))
    values = [secret(n) for n in (6, 80, 81, 300, 300, 5_000)]
    values.append(values[3][:-1] + ("a" if values[3][-1] != "a" else "b"))
    heads = ["token = ", '"api_key": "', "'password':'", 'secret="']
    texts = [f"so {h}{v} end" for v in values for h in heads]
    got = by_id(pii.pseudonymised(docs(spark, texts), "k", found="n"), "text", "n")
    shape = lambda x: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x)))
    new = {}
    for i, text in enumerate(texts):
        v, h = values[i // len(heads)], heads[i % len(heads)]
        out, n = got[i]
        assert n == 1 and out.startswith(f"so {h}") and out.endswith(" end")
        y = out[len(h) + 3 : -4]
        assert y != v and shape(y) == shape(v) and new.setdefault(v, y) == y
        if len(v) > 100:  # no part stays
            assert not any(v[j : j + 20] in y for j in range(0, len(v), 20) if len(re.findall("[a-zA-Z0-9]", v[j : j + 20])) > 9)
    assert len(set(new.values())) == len(new)


def test_feistel_is_a_permutation(spark):
    values = spark.range(27 * 100).select(F.array(F.floor(F.col("id") / 100), F.col("id") % 100).alias("v"))
    radices = F.array(F.lit(27).cast("bigint"), F.lit(100).cast("bigint"))
    out = values.select(pii.feistel(F.col("v"), radices, "t", "k").alias("o")).distinct().collect()
    assert len(out) == 2700 and all(0 <= r.o[0] < 27 and 0 <= r.o[1] < 100 for r in out)


# tokens

def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    library = tokenizers.Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    pool = ["a", "É", "ΣΑΣ", "İ", "ß", "中文", "123", "'LL", "don't", "<|endoftext|>", "\x00", "\x1c", "\x85", " ", "😀", "...", "é", "\n", " ", "ababab", "the", "ing"]
    texts = ["".join(rng.choice(pool, rng.integers(1, 25))) for _ in range(300)] + ["", "x" * 5_000, None, "the the"]
    got = by_id(bpe.encode(docs(spark, texts), path, decoded="decoded"), "ids", "decoded")
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i][0]) == ids and got[i][1] == library.decode(ids, skip_special_tokens=False)
    again = by_id(bpe.decode(bpe.encode(docs(spark, texts[:20]), path), path), "decoded")
    assert all(again[i][0] == got[i][1] for i in range(20))


# quality

def test_quality_measures_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = ["\n".join(" ".join(rng.choice(WORDS[:5], rng.integers(0, 9))) for _ in range(rng.integers(1, 9))) for _ in range(60)]
    texts += [None, "", "#$ a|b <é>", "a\n\na\n a", "w " * 30_000, "\x0b\x0c"]
    found = quality.judged(docs(spark, texts))
    for r in found.collect():
        t, m = texts[r.doc_id] or "", r.quality_rules.measures
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        assert (m.n_words, m.word_chars, m.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert (m.n_symbols, m.n_dup_lines) == (len(re.findall(quality.SYMBOLS, t)), len(lines) - len(set(lines)))
        assert r.quality_rules.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        assert not (r.quality_rules.kept and r.quality_rules.base_failed)


def test_rules_are_data(spark):
    rule = (quality.Rule("n_words", least=2, most=3),)
    text = " ".join(WORDS[:12])
    assert by_id(quality.judged(docs(spark, [text]), rule), "quality_rules")[0][0].kept is False


# pages

def test_main_text(spark):
    page = (
        '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>'
        '<div class="ad">Buy this now</div><article><h1>Head &amp; line</h1><p>One<b>two</b>&nbsp;three<br>four</p>'
        '<div class="comments"><p>I say no</p></div></article><aside>more</aside><footer>&copy; me</footer>'
    )
    plain = "<div id=content><h2>Title of it</h2><p>" + "word " * 40 + "</p><p>Short one.</p></div><div id='cookie-notice'>We use cookies</div>"
    pages = spark.createDataFrame([(0, "u", page), (1, "u", None), (2, "u", ""), (3, "u", plain), (4, "u", "<p>" * 50_000 + "x < y"), (5, "u", page)], "page_id bigint, text string, html string")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    assert got[0] == got[5] == "Head & line Onetwo three four"
    assert got[1] == got[2] == "" and got[4] == "x < y"
    assert got[3] == "Title of it " + "word " * 40 + "Short one."


# shards

@pytest.mark.parametrize("seed", range(3))
def test_smallest_capacity(seed):
    rng = np.random.default_rng(seed)
    sizes, k = rng.integers(1, 50, 12).tolist(), 4
    best = [[0] + [10**9] * len(sizes)]
    for _ in range(k):
        best.append([min(max(best[-1][j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)])
    assert sharding.smallest_capacity(sizes, k) == best[k][len(sizes)]


def test_shards(spark):
    texts = random_texts(4, 200) + ["same text"] * 60 + [None, "", "long " * 3_000]
    rows = sharding.shards(docs(spark, texts), 7).collect()
    assert len(rows) == len(texts)
    shards = collections.defaultdict(list)
    groups = collections.defaultdict(set)
    for r in rows:
        shards[r.shard].append(r)
        groups[texts[r.doc_id] or ""].add(r.shard)
    assert all(len(g) == 1 for g in groups.values()) and max(shards) < 7
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    digest = collections.Counter()
    for t in texts:
        digest[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 16
    assert max(sum(r.size for r in v) for v in shards.values()) == sharding.smallest_capacity([digest[d] for d in sorted(digest)], 7)


# tables without rows

def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for df in (
        licenses.license_scan(none), simhash.near_duplicates(none), simhash.near_deduplicated(none), decontaminate.report(none, bench),
        toxicity.scored(none, toxicity.Classifier()), repeats.repeats(none), pii.pseudonymised(none, "k"), bpe.encode(none, bpe.default_path()),
        quality.judged(none), sharding.shards(none), html.extracted(pages),
    ):
        assert df.count() == 0
    assert decontaminate.report(docs(spark, ["a b"]), bench).first().n_hit == 0


# pages whose markup leaves out what it may

@pytest.fixture(scope="module")
def tree(spark):
    return html.train_tree(spark)


LONG = "The text of the article goes on for a while, with words that say something about the matter."


@pytest.mark.parametrize("page, want", [
    (f"<html><head><title>x</title><body><article><p>{LONG}</p></article></body></html>", LONG),
    (f"<html><head><title>x</title><meta charset=utf-8><article><p>{LONG}</p></article>", LONG),
    (f"<title>x</title><article><p>{LONG}</p></article>", LONG),
    (f"<head><style>p {{}}</style><script>var a = '<p>'</script></head><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><div><select><option>one<option>two</div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><div><object data=x></div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><section><noscript><div>no</div></section><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><noscript><div>no</div></noscript><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><div><script>never closed</div><p>{LONG}</p></article>", LONG),
    (f'<article><p>{LONG}</p><p class="ad">Buy now and save a lot of money on the thing.</p><p>{LONG}</p></article>', f"{LONG} {LONG}"),
    (f'<article><p>{LONG}</p><ul><li class="comment">I think so too.<li>{LONG}</ul></article>', f"{LONG} {LONG}"),
    (f'<article><p>{LONG}</p><h3 class="related">More of this</h3><p>{LONG}</p></article>', f"{LONG} {LONG}"),
    (f'<article><h1 class="page-header">A title of words</h1><p>{LONG}</p></article>', f"A title of words {LONG}"),
    (f"<article><table><tr><td class=sidebar>{LONG}<td>{LONG}</table></article>", LONG),
])
def test_legal_pages(tree, page, want):
    assert html.main_text(page, tree) == want


def text_by_tokens(tokens):
    """What a reader of the token list says: text in articles that no mark or skipped element surrounds."""
    out, open_, line = [], [], []
    for kind, name, mark in tokens:
        if kind == "text":
            if not any(m or n in ("script", "select") for n, m in open_):
                line.append(name)
            continue
        out.append(" ".join(line))
        line = []
        if kind == "open":
            open_.append((name, mark))
        else:
            while open_.pop()[0] != name:
                pass
    return " ".join(filter(None, out))


def test_pages_of_random_tokens(tree):
    """Well-formed pages; elements that need no end tag lose it at random."""
    rng = np.random.default_rng(12)
    for _ in range(200):
        tokens, page, stack, words = [("open", "article", False)], ["<article>"], ["article"], iter(range(1_000))
        for _ in range(int(rng.integers(1, 30))):
            turn = rng.random()
            if turn < 0.4 and stack[-1] not in ("ul", "table", "tr"):
                text = f"w{next(words)} and some more words of the article here"
                tokens.append(("text", text, False))
                page.append(text + " ")
            elif turn < 0.75 and stack[-1] not in ("script", "select") and len(stack) < 6:
                name = "li" if stack[-1] == "ul" else str(rng.choice(["div", "section", "ul", "select", "script"]))
                mark = bool(rng.random() < 0.2)
                tokens.append(("open", name, mark))
                page.append(f'<{name} class="sponsored">' if mark else f"<{name}>")
                stack.append(name)
            elif len(stack) > 1:
                name = stack.pop()
                tokens.append(("close", name, False))
                if name != "li" or rng.random() < 0.5:
                    page.append(f"</{name}>")
                elif stack[-1] == "ul":  # the next tag ends it
                    stack.pop()
                    tokens.append(("close", "ul", False))
                    page.append("</ul>")
        while stack:
            name = stack.pop()
            tokens.append(("close", name, False))
            page.append(f"</{name}>")
        got = " ".join(t for t, f in html.blocks("".join(page)) if not f[6] and not f[7])
        assert got == text_by_tokens(tokens), "".join(page)


def test_a_result_overwrites_no_column(spark, tree):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "mine")], "page_id bigint, url string, html string, Text string")
    with pytest.raises(ValueError):
        html.extracted(pages, tree=tree)
    assert html.extracted(pages, to="body", tree=tree).columns == ["page_id", "url", "Text", "body"]


def test_a_result_takes_the_place_of_its_own_name(spark, tree):
    pages = spark.createDataFrame([(1, "old", "<article><p>new</p></article>", 7)], "page_id bigint, text string, html string, n int")
    found = html.extracted(pages, tree=tree)
    assert found.columns == ["page_id", "n", "text"] and found.first() == (1, 7, "new")
    found = html.extracted(pages, to="html", tree=tree)
    assert found.columns == ["page_id", "text", "n", "html"] and found.first() == (1, "old", 7, "new")
    with pytest.raises(ValueError):
        html.extracted(pages.withColumnRenamed("n", "TEXT"), tree=tree)


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 3_000)] + [(5_000 + i, 5_001 + i) for i in range(40)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(found[i] == 0 for i in range(3_000)) and all(found[5_000 + i] == 5_000 for i in range(41))
