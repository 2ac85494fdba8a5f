"""URL filter, secret scan, k-d sharding and decontamination against plain Python and small fixtures."""

import hashlib
import re
import zlib

from pyspark.sql import functions as F

from glyphmill.llm import decontam, kdshard, queries, secrets, url_filter

SF = "/root/testdata/sf0.001"


def judge(url: str | None) -> tuple:
    host = path = ""
    if url and "://" in url:
        rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), slash + path
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls_as_brute_force(spark):
    odd = [None, "", "no scheme", "http://", "http://EN.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://notexample.org/es/1", "x://com#/fr/", "http://a.com/de/é/" + "p" * 5000, "http://a.com/fr", "a://b://c/d", "http://..org//"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(odd + odd)], "page_id long, url string, rule string")
    rules = url_filter.rule_table(spark, queries.URL_RULES)
    for limit in (20_000, 1):  # also without a broadcast
        got = url_filter.filter_urls(pages, rules, broadcast_rows=limit).collect()
        assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(i, *judge(u)) for i, u in enumerate(odd + odd)} and len(got) == 2 * len(odd)
    assert url_filter.filter_urls(pages.where("false"), rules).collect() == []
    want = {(r.page_id, *judge(r.url)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {tuple(r) for r in queries.op1_url_filter(spark, SF).collect()} == want


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text: str | None) -> list[tuple[str, int, int]]:
    text, out = text or "", []
    for rank, (kind, pattern, least, group) in enumerate([("assign", ASSIGN, 8, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile("[0-9a-f]+"), 32, 0)]):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def test_secrets_as_brute_force(spark):
    odd = [None, "", "x", "PassWord = 'abcdefgh' 😀 token:short secret=12345678", "AKIA" + "A" * 11, "😀AKIA" + "B" * 12, "é" * 9 + "0f" * 16, "f" * 31, "api_key:" + "a" * 200_000, "token=password=abcdefgh"]
    rows = [(i, t) for i, t in enumerate(odd + odd)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, base string")
    got = secrets.scan_secrets(docs).select("doc_id", secrets.joined(F.col("base")).alias("b"), secrets.joined(F.col("found")).alias("f")).collect()
    assert {r.doc_id: r.b for r in got} == {i: ",".join(f"{k}:{s}:{e}" for k, s, e in base(t)) for i, t in rows} and len(got) == len(rows)
    assert all(set(r.b.split(",")) - {""} <= set(r.f.split(",")) for r in got)
    want = {i - 1000: hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base(t)).encode()).hexdigest() for i, t in rows if i >= 1000}
    assert {r.doc_id: r.base_sha256 for r in queries.op2_secret_scan(spark, SF).collect()} == want
    assert secrets.scan_secrets(docs.where("false")).collect() == []


def test_weak_parts_need_each_other(spark):
    key = "Zq8" * 8
    texts = [f"user: alice9\nhost https://db.example.org {key}", f"just {key}", "user: alice9", f"user: alice9\n\n{key}", "user: alice9" + " ." * 150 + key]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.scan_secrets(docs).select("doc_id", secrets.joined(F.col("found")).alias("f"), secrets.redact(F.col("text"), F.col("found")).alias("t")).collect()}
    assert [x.split(":")[0] for x in found[0].f.split(",")] == ["identifier", "endpoint", "opaque"] and key not in found[0].t
    assert [found[i].f for i in (1, 2, 3, 4)] == [""] * 4 and [found[i].t for i in (1, 2, 3, 4)] == texts[1:]


def test_dense_and_long_texts_take_linear_time(spark):
    import time

    line = "password = abcdefgh12345 \n"
    texts = [line * (256 * 1024 // len(line)), ("\n\nuser: alice9 https://db.example.org/x1 " + "Zq8" * 9) * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scan = lambda d: secrets.scan_secrets(d).select("doc_id", secrets.joined(F.col("base")).alias("b"), F.size("found").alias("n"), secrets.redact(F.col("text"), F.col("found")).alias("t"))
    scan(docs.where("false")).collect()
    began = time.time()
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert time.time() - began < 12
    assert got[0].b == ",".join(f"{k}:{s}:{e}" for k, s, e in base(texts[0])) and got[0].t == "[secret] \n" * (len(texts[0]) // len(line))
    assert got[1].n == 9000 and "alice9" not in got[1].t and "Zq8" not in got[1].t


def linked_by_hand(text, reach=200):
    """All spans of a text in plain Python: base ones, and weak ones beside another role in their paragraph."""
    rows = [(s, secrets.RANK[k], e, k) for k, s, e in base(text)]
    for kind, (pattern, least) in secrets.WEAK.items():
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least and (kind != "opaque" or re.search("[0-9]", m[0])):
                rows.append((m.start(), secrets.RANK[kind], m.end(), kind))
    scope = lambda at: len(re.findall(r"\n\n+", text[:at]))
    rows = [r for r in rows if not (r[3] == "opaque" and any(x[3] in ("identifier", "endpoint") and scope(x[0]) == scope(r[0]) and x[0] <= r[0] and r[2] <= x[2] for x in rows))]
    out = []
    for s, rank, e, kind in sorted(rows):
        beside = any(secrets.ROLE[k] != secrets.ROLE[kind] and scope(x) == scope(s) and (0 <= x - e <= reach or 0 <= s - y <= reach) for x, _, y, k in rows)
        if kind in secrets.BASE or beside:
            out.append(f"{kind}:{s}:{e}")
    return ",".join(out)


def test_linked_spans_as_plain_python(spark):
    import random

    rng, pieces = random.Random(4), ["user: alice9", "https://db.example.org/a1", "Zq8" * 8, "token=abcdefgh9", "0f" * 17, "\n\n", "\n\n\n\n", " . " * 60, "plain words", "é😀", "login=" + "k3y" * 9]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (50_000, 1):  # also without a broadcast
        got = {r.doc_id: r.f for r in secrets.scan_secrets(docs, broadcast_rows=limit).select("doc_id", secrets.joined(F.col("found")).alias("f")).collect()}
        assert got == {i: linked_by_hand(t) for i, t in enumerate(texts)}


def test_helper_columns_clash_with_nothing(spark):
    names = ["found", "bhost", "bpath", "judged_host", "judged_path", "judged_best", "own_key", "own_salt", "salt", "_key", "text_key", "gone_id", "twice_id", "_gone", "_twice", "n", "short", "digest"]
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("http://a.com/de/x token=abcdefgh9").alias("text"), *[F.lit(n).alias(n) for n in names])
    got = url_filter.filter_urls(rows.withColumnRenamed("text", "url"), url_filter.rule_table(spark, queries.URL_RULES)).collect()
    assert all(r.verdict == "block" and r.found == "found" and r.judged_host == "judged_host" for r in got) and len(got) == 3
    got = secrets.scan_secrets(rows).collect()
    assert all(len(r.base) == 1 and r.own_key == "own_key" and r.salt == "salt" for r in got) and len(got) == 3
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    leaks = decontam.find_leaks(rows, bench)
    assert decontam.decontaminate(rows, leaks).columns == rows.columns and decontam.decontaminate(rows, leaks).count() == 3
    from glyphmill.llm import jaccard

    kept = jaccard.one_per_group(rows, jaccard.similar_groups(rows))
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [0]


def found_in(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.f for r in secrets.scan_secrets(docs).select("doc_id", secrets.joined(F.col("found")).alias("f")).collect()}
    return [[x.split(":")[0] for x in got[i].split(",") if x] for i in range(len(texts))]


def test_long_parts_link_by_their_gap(spark):
    key = "Zq8" * 100
    texts = [f"{key} https://db.example.org", f"{key} user: alice9", f"https://db.example.org {key}", f"{key}{' .' * 150} user: alice9"]
    assert found_in(spark, texts) == [["opaque", "endpoint"], ["opaque", "identifier"], ["endpoint", "opaque"], []]


def test_one_string_is_one_part(spark):
    link, key = "https://example.org/blog/2023/10/some-long-title", "Zq8" * 8
    assert found_in(spark, [f"see {link} for more", f"user={key}", f"{link} and {link}", f"user={key} at {link}"]) == [[], [], [], ["identifier", "endpoint"]]


def test_shards_are_even_and_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = docs.unionByName(docs.limit(1).crossJoin(spark.range(400)).drop("id")).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    dims = {"lang": kdshard.category(F.col("lang")), "doc_id": F.col("doc_id")}
    want = sorted((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in hot.collect())
    got = kdshard.kd_shards(hot, dims, n_shards=6).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(6)}
    assert {r.shard for r in got} == set(range(6)) and all(v == list(range(len(v))) for v in slots.values())
    sizes, largest = [sum(r["size"] for r in got if r.shard == s) for s in range(6)], max(x[1] for x in want)
    assert max(sizes) - min(sizes) <= 4 * largest, sizes
    assert kdshard.kd_shards(hot.where("false"), dims, n_shards=6).collect() == []


def test_shards_of_odd_coordinates(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None, -1.0, 0.0, 1e300]
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, "word " * (200_000 if i == 5 else i % 7), odd[i % 7], "clash") for i in range(70)], "doc_id long, text string, x double, node string")
    got = kdshard.kd_shards(docs, {"x": F.col("x"), "doc_id": F.col("doc_id")}, n_shards=5).collect()
    assert len(got) == 70 and {r.shard for r in got} <= set(range(5))  # one text outweighs all others
    assert sum(r["size"] for r in got) == sum(len("word " * (200_000 if i == 5 else i % 7)) + 8 for i in range(70))


def test_shards_follow_a_plain_tree(spark):
    """Distinct coordinates of equal weight: every split is the plain weighted median of the widest dimension."""
    import random

    rng = random.Random(6)
    rows = [(i, "x" * 92, rng.random() * 10, rng.random() * 3) for i in range(96)]

    def split(part, k, first, spread):
        if k == 1:
            return {r[0]: first for r in part}
        d = max((2, 3), key=lambda j: ((max(r[j] for r in part) - min(r[j] for r in part)) / spread[j], -j))
        part = sorted(part, key=lambda r: r[d])
        at = round(len(part) * (k // 2) / k)
        return split(part[:at], k // 2, first, spread) | split(part[at:], k - k // 2, first + k // 2, spread)

    want = split(rows, 6, 0, {j: max(r[j] for r in rows) - min(r[j] for r in rows) for j in (2, 3)})
    docs = spark.createDataFrame(rows, "doc_id long, text string, x double, y double")
    got = {r.doc_id: r.shard for r in kdshard.kd_shards(docs, {"x": F.col("x"), "y": F.col("y")}, n_shards=6).collect()}
    assert got == want


ITEM = "A train leaves Berlin at noon and travels 120 km in 2 hours before Maria boards it, what speed in km does it keep over those 120 km"


def test_reparameterised_questions_are_found(spark):
    other = ITEM.replace("120", "345").replace("Maria", "Ivan").replace("2 hours", "5 hours")
    torn = ITEM.replace("120", "345", 1)  # one slot value stands for two
    clean = "The weather over the hills was calm and nobody on the farm thought of leaving before the end of the long harvest season that year"
    texts = [f"Some words first. {ITEM} and more after it.", f"Intro {other} end", f"Intro {torn} end", clean, None, "", ITEM, ITEM]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (7, ITEM)], "item_id long, text string")
    for limit in (100_000, 1):
        leaks = decontam.find_leaks(docs, bench, broadcast_rows=limit)
        got = {(r.doc_id, r.item_id) for r in decontam.leaked_documents(docs.select("doc_id", "text"), leaks).collect()}
        assert got == {(0, 7), (1, 7), (6, 7), (7, 7)}
    kept = decontam.decontaminate(docs, leaks)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert decontam.find_leaks(docs.where("false"), bench).collect() == [] == decontam.find_leaks(docs, bench.where("false")).collect()


def test_short_runs_are_found_at_every_place(spark):
    words = [f"{a}{b}ta" for a in "bdfg" for b in "aei"]
    runs = {12: [*words[:10], "zzz", "yyy"], 8: [*words[:8], "zzz", "yyy", "xxx", "vvv"]}  # shared words of twelve: ten, eight
    texts = [" ".join(["filler"] * k + run) for run in runs.values() for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = decontam.leaked_documents(docs, decontam.find_leaks(docs, bench)).collect()
    assert sorted((r.doc_id, r.matched) for r in got) == [(i, 10 if i < 8 else 8) for i in range(16)]


def test_slots_may_share_a_value_and_alignments_add_up(spark):
    shared = "the farmer keeps 3 apples and 4 pears in one basket near the barn door until noon"
    named = "before the long winter storm the old sailor met Maria on the narrow bridge over the cold river"
    plain = "an old train leaves the quiet valley at dawn and reaches the busy harbour long before any of the boats"
    texts = [
        shared.replace("3", "5").replace("4", "5"), named.replace("Maria", "Ivan Petrov"), named,
        plain.replace("and reaches", "and slowly reaches"), plain.replace("dawn and", "dawn"), plain.replace("quiet valley", "loud city"), "an old train leaves the quiet valley at dawn",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, shared), (2, named), (3, plain)], "item_id long, text string")
    got = decontam.leaked_documents(docs, decontam.find_leaks(docs, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, 2), (2, 2), (3, 3), (4, 3), (5, 3)}
    assert all(r.matched <= r.item_words for r in got)


def templates_by_hand(text):
    """(raw, template) words of a text, where a run of equal placeholders is one slot."""
    import regex

    t = regex.sub(rf"(?<=[0-9])(\x20?)(?:{decontam.UNITS})(?![\p{{L}}\p{{N}}])", r"\1#unit", text)
    t = regex.sub(r"(?<=[\p{Ll},;:]\x20)\p{Lu}\p{Ll}+", "#name", t)
    t = regex.sub(r"[0-9]+(?:[.,][0-9]+)*", "#num", t)
    t = regex.sub(r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}#\x20\x09-\x0D]+", "", t).lower()
    raw, tpl = ([w for w in regex.split(r"[\x20\x09-\x0D]+", x) if w] for x in (text, t))
    out = []
    for r, w in zip(raw, tpl, strict=True):
        if out and w in ("#num", "#name", "#unit") and out[-1][1] == w:
            out[-1] = (f"{out[-1][0]} {r}", w)
        else:
            out.append((r, w))
    return out


def one_value_each(pairs):
    """Whether every slot value of the item meets one value of the document; ``pairs``: item word -> (document word, item word)."""
    value = {}
    return all("#" not in it[1] or value.setdefault(it, d[0]) == d[0] for d, it in pairs.values())


def leak_by_hand(doc, item, window=8, coverage=0.6, drift=4):
    """(matched, exact, -pos) of the best alignment of an item with a document, or None."""
    n, runs = min(window, len(item)), {}
    for p in range(len(doc) - n + 1):
        runs.setdefault(tuple(w for _, w in doc[p : p + n]), []).append(p)
    places = {p - q for q in range(len(item) - n + 1) for p in runs.get(tuple(w for _, w in item[q : q + n]), [])} if item else set()
    agree = {pos: {i: (doc[pos + i], it) for i, it in enumerate(item) if 0 <= pos + i < len(doc) and doc[pos + i][1] == it[1]} for pos in places}
    best = []
    for pos in places:
        have = dict(agree[pos])
        if not one_value_each(have):
            continue
        for other in sorted(places - {pos}, key=lambda x: (abs(x - pos), x)):
            if abs(other - pos) <= drift:
                at = agree[other]
                more = {i: v for i, v in at.items() if any(all(i - k + j in at for j in range(3)) for k in range(3))}
                if one_value_each(more | have):
                    have = more | have
        if len(have) >= coverage * len(item):
            best.append((len(have), sum(d[0] == it[0] for d, it in have.values()), -pos))
    return max(best, default=None)


def leaks_by_hand(docs, bench):
    docs, out = [(i, templates_by_hand(t or "")) for i, t in docs], set()
    for item_id, text in bench:
        item = templates_by_hand(text or "")
        for doc_id, doc in docs:
            if item and (b := leak_by_hand(doc, item)):
                out.add((doc_id, item_id, b[0], len(item), b[1], -b[2]))
    return out


def test_leaks_of_whole_tables_equal_a_plain_matcher(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = [(r.doc_id, r.item_id, r.matched, r.item_words, r.exact, r.pos) for r in queries.op9_decontamination(spark, SF).collect()]
    assert len(got) == len(set(got))
    assert set(got) == leaks_by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_leaks_of_altered_items_equal_a_plain_matcher(spark):
    import random

    rng, plain = random.Random(9), [f"{a}{b}{c}" for a in "bdfgk" for b in "aeio" for c in ("n", "ra", "st")]
    slots = [lambda: rng.choice(["Maria", "Ivan", "Zoe", "Tom"]), lambda: str(rng.randrange(1, 6)), lambda: f"{rng.randrange(2, 9)} km", lambda: f"{rng.randrange(2, 9)}kg,"]
    some = lambda: rng.choice(slots)() if rng.random() < 0.25 else rng.choice(plain)
    bench = [(i, " ".join(some() for _ in range(rng.choice([3, 7, 8, 9, 14, 25, 40])))) for i in range(40)]
    bench += [(40, "la " * 12), (41, bench[0][1]), (42, bench[1][1]), (42, bench[1][1])]

    def altered(text):
        words = text.split()
        for _ in range(rng.randrange(4)):
            k, what = rng.randrange(len(words)), rng.randrange(4)
            words[k : k + 1] = [[some()], [], [words[k], some()], [rng.choice(["Maria Zoe", "7", "Ivan"])]][what]
            words = words or ["x"]
        return " ".join(words)

    docs = []
    for i in range(150):
        parts = [altered(rng.choice(bench)[1]) if rng.random() < 0.6 else " ".join(some() for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 5))]
        docs.append((i, " ".join(parts)))
    docs += [(150, docs[3][1]), (151, None), (152, ""), (153, "la " * 30), (154, "é Ünï " + bench[5][1] + " 😀"), (155, "bat " * 20_000 + bench[4][1])]
    rows, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = leaks_by_hand(docs, bench)
    assert len(want) > 100
    for limit in (100_000, 1):
        found = decontam.leaked_documents(rows, decontam.find_leaks(rows, items, broadcast_rows=limit), broadcast_rows=limit)
        assert {(r.doc_id, r.item_id, r.matched, r.item_words, r.exact, r.pos) for r in found.collect()} == want
