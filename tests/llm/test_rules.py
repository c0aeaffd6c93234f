import collections
import hashlib
import re

from wordloom.llm import pii, quality, secrets


def base_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_rules_equal_brute_force(documents, odd, nothing):
    for df in (documents, odd):
        got = quality.judged(df).select("wl_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        want = sorted(repr((r.doc_id, *base_rules(r.text))) for r in df.collect())
        assert sorted(repr(tuple(r)[:-1]) for r in got) == want
        assert not any(r.kept for r in got if r.base_failed)
    assert quality.judged(nothing).count() == 0


def test_junk_goes_and_prose_stays(documents):
    rows = quality.judged(documents).filter("not base_failed").select("wl_row.text", "kept").collect()
    junk = [r.kept for r in rows if sum(c in "#*$%&" for c in r.text) > 0.1 * len(r.text) and len(r.text) > 600]
    prose = [r.kept for r in rows if not re.search(r"[#*$%&|<>]|!!", r.text)]
    assert prose and sum(prose) >= 0.99 * len(prose)
    assert junk and not any(junk)


def test_a_wrong_language_is_no_fault(documents):
    from pyspark.sql import functions as F

    refs = quality.references(documents)
    assert [r["lang"] for r in refs] == ["de", "en", "es", "fr"]
    right = {r[0]: r[1] for r in quality.judged(documents, refs=refs).select("wl_row.doc_id", "kept").collect()}
    wrong = {r[0]: r[1] for r in quality.judged(documents.withColumn("lang", F.lit(None).cast("string")), refs=refs).select("wl_row.doc_id", "kept").collect()}
    assert right == wrong


def test_every_language_is_judged_by_its_own_words(spark):
    import random

    rng = random.Random(8)
    rows = []
    for k in range(20):
        vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
        share = [1 / (i + 3) for i in range(400)]
        for _ in range(3 if k == 19 else 60 - k):
            rows.append((len(rows), " ".join(rng.choices(vocabulary, share, k=150)), f"l{k:02d}", True))
    rows += [(len(rows) + i, " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(150)), "l17", False) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean")
    assert [r["lang"] for r in quality.references(df)] == [f"l{k:02d}" for k in range(19)]
    got = quality.judged(df).select("wl_row.lang", "wl_row.good", "kept").collect()
    assert not any(r.kept for r in got if not r.good)
    assert all(r.kept for r in got if r.lang == "l19") and sum(r.kept for r in got if r.good) >= 0.99 * sum(r.good for r in got)


def test_repeats_in_a_long_list(spark):
    words = [str(i) for i in range(400)] * 2
    df = spark.createDataFrame([(1, " ".join(words), "en")], "doc_id long, text string, lang string")
    assert quality.judged(df).first().n_repeat_words == 800


SECRETS = {
    "assign": (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return (sum(odd[0::2]) + sum(sum(divmod(2 * c, 10)) for c in odd[1::2])) % 10 == 0


def card(m):
    digits = re.sub("[^0-9]", "", m[0])
    return 12 <= len(digits) <= 19 and luhn(digits)


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", card),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


def base_spans(kinds, text):
    found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def check_base(kinds, df, query):
    texts = sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    got = sorted(query(df.sparkSession, df).collect(), key=lambda r: repr((r.doc_id,)))
    want = sorted(repr((i, *[sum(s.startswith(f"{k}:") for s in base_spans(kinds, t)) for k in kinds], hashlib.sha256(",".join(base_spans(kinds, t)).encode()).hexdigest())) for i, t in texts)
    assert sorted(repr(tuple(r)[:-1]) for r in got) == want
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, set()).update(filter(None, r.spans.split(",")))
    for i, t in texts:
        assert set(base_spans(kinds, t)) <= spans[i]


def made(spark, pieces, seed, n=600):
    import random

    rng = random.Random(seed)
    return spark.createDataFrame([(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 20)))) for i in range(n)], "doc_id long, text string")


def test_secrets_equal_brute_force(spark, documents, odd, nothing):
    parts = ["token = ", "'abc'", "secret: ", "AKIA" + "X1" * 8, "AKIA123", "deadbeef" * 3, " ", "\n\n", "api_key=", 'apikey : "', "Zz9+/abcDEF", "é日本", "PASSWORD=", "=", "hunter22", "https://x.example/", "ABCD1234EFGH5678", "user: bob", "aB3" * 9, "pwd=letmein99"]
    for df in (documents, odd, made(spark, parts, 1)):
        check_base(SECRETS, df, secrets.query)
    assert secrets.query(spark, nothing).count() == 0


def added(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.query(spark, df).first().spans
    return [s for s in filter(None, spans.split(",")) if s.split(":")[0] in ("id", "secret", "endpoint")], text


def test_weak_parts_need_their_complement(spark):
    key = "aB3dE6gH9jK2mN5pQ8sT1vW4"
    assert added(spark, f"the value {key} alone")[0] == []
    spans, text = added(spark, f"client_id = web7 then {key}")
    assert {s.split(":")[0] for s in spans} == {"id", "secret"}
    assert [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans] == ["client_id = web7", key]
    assert added(spark, f"client_id = web7\n\n{key}")[0] == []  # another scope
    assert added(spark, f"client_id = web7{' x' * 200} {key}")[0] == []  # too far
    spans, _ = added(spark, f"https://db.example/x login: bob {key}")
    assert {s.split(":")[0] for s in spans} == {"id", "secret", "endpoint"}


def test_long_parts_are_found_whole(spark):
    for key in ("aB3dE6gH9j" * 20, "A1" * 60 + "z" * 60, "A" * 60 + "z1"):
        spans, text = added(spark, f"client_id = web7 then {key}")
        assert [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans] == ["client_id = web7", key]
    for parts in (["AB12" * 15, "pwd=" + "x9!" * 100, "login: " + "bob." * 30], ["login: bob", "pwd=letmein99", "https://db.example/" + "x/" * 300], ["login: bob", "pwd=letmein99", "host=" + "a." * 100]):
        spans, text = added(spark, " ".join(parts))
        assert [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans] == parts


def test_many_parts_in_one_text(spark):
    df = spark.createDataFrame([(1, "user: bob pwd=letmein99 " * 4000)], "doc_id long, text string")
    assert len(secrets.query(spark, df).first().spans.split(",")) == 8000


def test_personal_data_equal_brute_force(spark, documents, odd, nothing):
    parts = ["a@b.c", "x_y", "@", "mail.example", ".", "192.168.0.1", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "+49 30", " ", "  ", "\n", "é日本", "12", "0", "-", "00255.1.1.1", "_%+", "a@b.c_d@e.f", "@x.y"]
    for df in (documents, odd, made(spark, parts, 2)):
        check_base(PERSONAL, df, pii.query)
    assert pii.query(spark, nothing).count() == 0


def test_contexts_give_unseen_numbers_away(spark):
    rows = [(i, f"please call me on +614{i:08d} now") for i in range(20)]
    rows += [(100 + i, f"please call me on 04{i:08d} now") for i in range(5)] + [(200, "we sold 0412345678 of them"), (201, "again 0400000003 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.query(spark, df).collect()}
    assert all(got[100 + i] == "phone:18:28" for i in range(5))
    assert got[200] == "" and got[201] == "phone:6:16"  # an instance that is known by now
    masked = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert masked[103] == masked[7] == "please call me on [PHONE] now" and masked[201] == "again [PHONE] here" and masked[200] == rows[25][1]


def test_contexts_reach_over_numbers(spark):
    rows = [(i, f"see ext 4 phone +614{i:08d} now") for i in range(20)] + [(100, "see ext 4 phone 5550199222 now")]
    rows += [(200 + i, f"please write to bob{i}@mail.example today") for i in range(20)] + [(300, "please write to jane.doe@intranet today")]
    got = {r.doc_id: r.spans for r in pii.query(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:16:26" and got[300] == "email:16:33"


def test_discovery_goes_on_until_nothing_is_added(spark):
    """Each context is known only by the numbers that the one before it gives away."""
    steps = ["call me", "ring him", "dial her", "fax us", "text them"]
    rows = [f"call me +614{i:08d} now" for i in range(20)]
    for k, step in enumerate(steps):
        rows += [f"{step} 04{j}{i:07d} now" for j in (k - 1, k) if j >= 0 for i in range(5)] + [f"{step} +614{i:08d} now" for i in range(4)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert all(r.spans for r in pii.query(spark, df).collect())


def test_redaction_leaves_no_span(documents, odd):
    for df in (documents, odd):
        out = pii.redacted(df)
        assert out.columns == df.columns and out.count() == df.count()
        assert not any(base_spans(PERSONAL, r.text) for r in out.collect())


def linked_by_all_pairs(text):
    """Weak parts that complementary parts meet: every part against every other."""
    import regex

    text = text or ""
    strong = [(int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in base_spans(SECRETS, text)]
    weak = [(m.start(), m.end(), k) for k, p in secrets.WEAK.items() for m in regex.finditer(p, text) if m.end() - m.start() >= secrets.LEAST]
    weak = [w for w in weak if not any(s[0] < w[1] and w[0] < s[1] for s in strong)]
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    parts = [(a, b, k, sum(x < a for x in breaks)) for a, b, k in strong + weak]

    def meets(p, roles):
        return any(q[2] in roles and q[3] == p[3] and (q[0] >= p[1] or q[1] <= p[0]) and q[0] - p[1] <= secrets.REACH and p[0] - q[1] <= secrets.REACH for q in parts)

    return {f"{p[2]}:{p[0]}:{p[1]}" for p in parts if p[2] in secrets.MEETS and all(meets(p, roles) for roles in secrets.MEETS[p[2]])}


def test_links_equal_all_pairs(spark, odd):
    parts = ["token = abcdef1", "AKIA" + "X1" * 8, "deadbeef" * 3, " ", " ", "\n", "\n\n", " word" * 30, " x" * 70, "https://x.example/", "ABCD1234EFGH5678", "user: bob77", "aB3" * 9, "pwd=letmein99", "host=a.b.c"]
    for df in (odd, made(spark, parts, 5, 1500)):
        texts = {}
        for r in df.collect():
            texts.setdefault(r.doc_id, []).append(r.text)
        for r in secrets.query(spark, df).collect():
            got = {s for s in r.spans.split(",") if s.split(":")[0] in secrets.WEAK}
            assert any(got == linked_by_all_pairs(t) for t in texts[r.doc_id]), r.doc_id


def discovered_by_hand(texts):
    """Spans that bootstrapping adds, by dictionaries over all texts."""
    shaped = lambda i: any(re.search(p, i) for p in pii.SHAPES.values())

    def pattern(left):
        found = re.search(r"(?:^|\s)(\S+\s+\S+)\s*$", left)
        return re.sub("[0-9]", "0", re.sub(r"\s+", " ", found[1]).lower()) if found else ""

    pairs, tokens = {}, []
    for n, text in enumerate(texts):
        base = [s.split(":") for s in base_spans(PERSONAL, text)]
        for kind, a, b in base:
            key = pattern(text[: int(a)]), text[int(a) : int(b)]
            pairs[key] = max(pairs.get(key) or "", kind)
        for m in re.finditer(pii.TOKEN, text):
            instance = re.sub(r"[._/#+@-]+$", "", m[0])
            wide = len(m[0]) >= 6 and len(re.sub("[^0-9]", "", m[0])) >= 4
            if len(m[0]) >= 3 and (wide or shaped(instance)) and not any(int(a) < m.start() + len(instance) and m.start() < int(b) for _, a, b in base):
                tokens.append((n, m.start(), instance))
                pairs.setdefault((pattern(text[: m.start()]), instance), None)
    known = {}
    for (_, i), kind in pairs.items():
        if kind:
            known[i] = max(known.get(i, ""), kind)
    seeds, new = dict(known), {}
    while True:
        patterns = {}
        for p, i in pairs:
            if p:
                patterns.setdefault(p, collections.Counter())[known.get(i)] += 1
        good = {}
        for p, c in patterns.items():
            kind = max((k for k in PERSONAL), key=lambda k: (c[k], k))
            if c[kind] >= pii.SUPPORT and c[kind] / sum(c.values()) >= pii.CONFIDENCE:
                good[p] = kind, c[kind] / sum(c.values())
        doubt = {}
        for (p, i), kind in pairs.items():
            if kind is None and p in good and re.search(pii.SHAPES[good[p][0]], i):
                doubt[i, good[p][0]] = doubt.get((i, good[p][0]), 1.0) * max(1 - good[p][1], 1e-9)
        best = {}
        for (i, kind), d in doubt.items():
            if 1 - d >= pii.BELIEF:
                best[i] = max(best.get(i, (0.0, "")), (1 - d, kind))
        more = {i: k for i, (_, k) in best.items() if i not in new}
        if not more:
            break
        new |= more
        known = seeds | {i: k for i, k in new.items() if i not in seeds}
    return [{f"{new[i]}:{a}:{a + len(i)}" for m, a, i in tokens if m == n and i in new} for n in range(len(texts))]


def test_discovery_equals_brute_force(spark):
    """Templates with identifiers that the base finds, others that it does not, and numbers that are none."""
    import random

    rng = random.Random(9)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    kinds = {
        "please ring": [lambda: f"+614{number(8)}"] * 4 + [lambda: f"04{number(8)}", lambda: f"9{number(3)}-{number(4)}"],
        "server at": [lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7"] * 4 + [lambda: f"10.{rng.randint(256, 999)}.1.7"],
        "write to": [lambda: f"{rng.choice('abcde')}{number(2)}@mail.example"] * 4 + [lambda: f"{rng.choice('abcde')}{number(2)}@intranet"],
        "order number": [lambda: number(8), lambda: f"04{number(8)}"],
    }
    texts = []
    for _ in range(400):
        words = []
        for _ in range(rng.randint(1, 4)):
            context = rng.choice(list(kinds))
            words += [rng.choice(["so", "then", "see 4,"]), context, rng.choice(kinds[context])() + rng.choice(["", ".", ","])]
        texts.append(" ".join(words))
    got = {r.doc_id: r.spans for r in pii.query(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = discovered_by_hand(texts)
    assert sum(map(len, want)) > 100
    for n, text in enumerate(texts):
        assert set(filter(None, got[n].split(","))) == set(base_spans(PERSONAL, text)) | want[n]
    wrong = sum("order number " in texts[n][: int(s.split(":")[1])][-15:] for n in range(400) for s in want[n])
    assert wrong <= 0.2 * sum(map(len, want))


def test_long_texts_with_very_many_spans(spark):
    text = "\n".join(f"192.168.0.{i % 250} user: bob pwd=letmein99 order {10000000 + i}\n" for i in range(16000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.query(spark, df).first().n_ip == 16000
    assert len(secrets.query(spark, df).first().spans.split(",")) == 32000


def test_verdicts_equal_sql(spark, documents, data):
    import duckdb

    from wordloom.llm.oracles import oracle_sql

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.sql(oracle_sql()["op4_divergence_rules"])
    got = quality.query(spark, documents).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
