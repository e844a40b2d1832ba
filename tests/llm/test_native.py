import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from terraloom.llm import decontaminate, mixing, quality_rules, sharding
from tests.llm.conftest import prose

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def brute_figures(text):
    text = text or ""
    w = [x for x in SPACES.split(text) if x]
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACES.sub("", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_figures_against_brute_force(make, odd):
    rows = [*odd, (20, ("a b c d e f g h " * 3 + "\n") * 4), (21, prose(1, 300, 3)), (22, "x\ny\nx\n\n\nx"), (23, "😀 " * 25), (24, "a b c d e f g h i a b c d e f g h")]
    texts = {r[0]: r[1] for r in rows}
    got = quality_rules.quality_report(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_figures(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert r["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_bad_hosts_lose_good_documents(make):
    rows = [(i, prose(i, 40, 10**5), "good") for i in range(50)] + [(100 + i, "short", "bad") for i in range(45)] + [(200 + i, prose(200 + i, 40, 10**5), "bad") for i in range(5)] + [(300, prose(9, 40), "once")]
    got = {r["doc_id"]: r for r in quality_rules.quality_report(make(rows)).collect()}
    assert all(got[i]["kept"] for i in range(50)) and not any(got[200 + i]["kept"] for i in range(5)) and got[300]["kept"]
    kept = quality_rules.keep_good(make(rows))
    assert kept.columns == make(rows).columns and kept.count() == 51


def test_small_hosts_are_judged_by_the_prior(make):
    """Of a host with few documents, few failures say little; most failing of many say enough."""
    good = lambda i: prose(i, 40, 10**5)
    rows = [(1000 * h + i, good(1000 * h + i) if i % 20 else "short", f"h{h}") for h in range(6) for i in range(60)]
    rows += [(9000, "short", "few"), (9001, good(1), "few")]
    rows += [(9100 + i, "short" if i < 12 else good(9100 + i), "bad") for i in range(16)]
    got = {r["doc_id"]: r for r in quality_rules.quality_report(make(rows)).collect()}
    assert got[9001]["kept"] and not any(got[9100 + i]["kept"] for i in range(16)) and all(got[1000 * h + 1]["kept"] for h in range(6))
    judged = make(rows).select("source", (quality_rules.F.length("text") < 50).alias("failed"))
    verdicts = {r["host"]: r for r in quality_rules.host_verdicts(judged, failed="failed").collect()}
    want = brute_hosts([(s, len(t) < 50) for _, t, s in rows])
    assert {h: (r["rate"], r["sure"], r["rejected"]) for h, r in verdicts.items()} == {h: (pytest.approx(x), pytest.approx(y), z) for h, (x, y, z) in want.items()}
    assert want["bad"][2] and not want["few"][2]


def brute_hosts(rows):
    """(rate, sure, rejected) by host, from the moments of the beta-binomial."""
    hosts = defaultdict(list)
    for h, failed in rows:
        hosts[h].append(failed)
    n, m = len(rows), sum(f for _, f in rows) / len(rows)
    between = sum(len(x) * (sum(x) / len(x) - m) ** 2 for x in hosts.values())
    chance = (len(hosts) - 1) * m * (1 - m)
    freedom = n - sum(len(x) ** 2 for x in hosts.values()) / n - (len(hosts) - 1)
    share = (between - chance) / freedom / (m * (1 - m))
    s = max(1 / share - 1, 1e-3) if share > 1e-6 else 1e6
    out = {}
    for h, x in hosts.items():
        rate = (sum(x) + m * s) / (len(x) + s)
        sure = rate - 2 * (rate * (1 - rate) / (len(x) + s + 1)) ** 0.5
        out[h] = rate, sure, sure >= 0.3
    return out


def test_a_host_falls_in_sql_too(spark, make):
    import duckdb

    rows = [(i, prose(i, 40, 10**5), f"h{i % 5}") for i in range(200)] + [(300 + i, "short" if i < 45 else prose(i, 40, 10**5), "bad") for i in range(50)] + [(400, prose(9, 40), None)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = db.execute(quality_rules.ORACLE)
    names = [d[0] for d in found.description]
    want = {r[0]: r for r in found.fetchall()}
    got = quality_rules.quality_report(make(rows)).select(*names).collect()
    assert {r["doc_id"]: tuple(r) for r in got} == want
    assert sum(not r["base_failed"] and not r["kept"] for r in got) == 5


def test_quality_of_nothing(make):
    assert quality_rules.quality_report(make([])).count() == quality_rules.keep_good(make([])).count() == 0


def test_null_host_is_a_host(make, odd):
    assert quality_rules.keep_good(make([(1, prose(1, 50), None), (2, prose(2, 50), None)])).count() == 2


def test_clashing_names_are_kept(clashing, items):
    from terraloom.llm import simhash

    rows = [(i, prose(i, 60, 10**5), f"s{i % 2}") for i in range(6)]
    docs = clashing(rows)
    for stage in (quality_rules.keep_good, simhash.one_of_each, lambda d: decontaminate.without_leaks(d, items), mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert {r["doc_id"] for r in got} == set(range(6))
        assert all(r[c] == c for r in got for c in docs.columns[5:])
    assert len(sharding.shard(docs).collect()) == 6
    assert len(quality_rules.quality_report(docs).collect()) == len(mixing.draws(docs).select("doc_id").distinct().collect()) == 6
    assert simhash.near_duplicates(docs).count() == 6 and decontaminate.leaks(docs, items).count() == 0


def test_shards(make, odd):
    rows = [*odd, *((100 + i, f"text {i % 50}") for i in range(900))]
    got = sharding.shard(make(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40 and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert sizes[1] == (16, 0) and sizes[2] == (16, 0) and sizes[8][0] == len(("é ü ß " * 30).encode()) + 16
    assert len(by) == 40 and sum(r["grown_shard"] == 40 for r in got) > 0
    assert sharding.shard(make([])).count() == 0


def test_shards_follow_weights(make):
    weights = tuple([4.0] + [1.0] * 6 + [0.0])
    n = Counter(r["shard"] for r in sharding.shard(make([(i, "") for i in range(4000)]), weights=weights).collect())
    assert n[7] == 0 and 0.3 < n[0] / 4000 < 0.5


@pytest.mark.parametrize("block", [4, 2048])
def test_mixture(make, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rows = [(i, prose(i, 20 + i % 5), "big") for i in range(300)] + [(1000 + i, prose(i, 30), "small") for i in range(30)] + [(2000, None, "none"), (2001, "", None), (2002, prose(1, 7), None)]
    docs = make(rows)
    got = mixing.draws(docs).collect()
    tokens = defaultdict(int)
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    total = sum(tokens.values())
    drawn, weight = defaultdict(int), {}
    for r in got:
        drawn[r["source"]] += r["tokens"]
        weight[r["source"]] = r["weight"]
        assert r["at"] < r["weight"] * total or r["tokens"] == 0
    for s, t in tokens.items():
        if t:
            assert abs(drawn[s] - weight[s] * total) <= 60 and drawn[s] <= 4 * t + 60
    assert weight["small"] > tokens["small"] / total
    assert {r["doc_id"] for r in got if r["source"] == "none"} == {2000}
    # Each epoch draws a row once at most, and a later one only where the earlier drew it.
    seen = Counter((r["doc_id"], r["epoch"]) for r in got)
    assert max(seen.values()) == 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == {r[0] for r in rows} and len(rows) < mixed.count() < 1.3 * len(rows)


def solved(tokens, budget, entropy_share, max_repetition):
    live = [t for t in tokens if t > 0]
    x, z, b = mixing.solve(sum(live), min(live), max(live), len(live), mixing.sums_of(tokens), budget, entropy_share, max_repetition)
    return x, [(t / sum(live)) ** x / z if t > 0 else 0.0 for t in tokens], b


def test_exponent():
    tokens = [1000.0, 100.0, 10.0, 0.0]
    for share in (0.3, 0.6, 0.9):
        x, w, _ = solved(tokens, 1110.0, share, 1e9)
        assert abs(-sum(v * math.log(v) for v in w if v) - share * math.log(3)) < 1e-6 or x == 1.0
    _, w, budget = solved(tokens, 1110.0, 1.0, 4.0)
    assert abs(sum(w) - 1) < 1e-9 and max(w[i] * budget / tokens[i] for i in range(3)) <= 4.0 + 1e-6
    assert mixing.solve(0.0, 0.0, 0.0, 0, lambda xs: [], 5.0, 0.9, 4.0)[2] == 0.0
    _, w, budget = solved(tokens, None, None, 1.25)
    assert min(w[i] * budget / tokens[i] for i in range(3)) > 1 - 1e-6 and max(w[i] * budget / tokens[i] for i in range(3)) <= 1.25 + 1e-6


def test_many_sources_are_mixed_by_spark_alike(make):
    """Above the number of sources that are summed on the driver, weights and draws are the same."""
    rows = [(i, prose(i, 5 + i % 90), f"s{i % (1 + i % 40)}") for i in range(500)] + [(900, None, "none")]
    one, two = ({(r["doc_id"], r["epoch"]): (r["weight"], r["at"]) for r in mixing.mixture(make(rows), keys_only=True, few=few).select("row.*", "draw.*").collect()} for few in (10**6, 0))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_mixture_in_sql_too(make):
    """Skewed sources, so that the exponent falls below 1 and small sources are drawn several times."""
    import duckdb

    rows = [(i, prose(i, 30 + i % 9), "big") for i in range(400)] + [(1000 + i, prose(i, 20), f"small{i % 4}") for i in range(40)] + [(2000, None, "none"), (2001, "a b c", None), (None, prose(5, 9), "small1")]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = db.execute(mixing.ORACLE)
    names = [d[0] for d in found.description]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(r) for r in found.fetchall()), key=key)
    got = mixing.draws(make(rows)).withColumn("weight", quality_rules.F.round("weight", 9)).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=key) == want and max(r["epoch"] for r in got) > 0


def test_mixture_of_nothing(make, odd):
    assert mixing.draws(make([])).count() == 0
    assert {r["doc_id"] for r in mixing.mixed_documents(make(odd)).collect()} == {r[0] for r in odd}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "The farmer Anna sold 12 apples for 30 euros to Peter and kept 18 apples for herself on Monday"), (2, prose(77, 30, 10**5)), (3, "too short"), (4, None), (2, prose(77, 30, 10**5)), (5, "How many km does a train at 90 kmh go in 4 hours if it stops for 10 minutes at each of 3 stations")]
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks(make, items, rows, **kw):
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.leaks(make(rows), items, **kw).collect()}


def test_leaks_are_found_wherever_they_stand(make, items):
    rows = [(10 + k, prose(k, k) + " " + prose(77, 30, 10**5) + " " + prose(500 + k, 40)) for k in range(14)] + [(90, prose(3, 500))]
    assert leaks(make, items, rows) == {(10 + k, 2): False for k in range(14)}


def test_other_numbers_names_and_units_are_caught_if_consistent(make, items):
    good = "Once upon. The farmer Olga sold 77 apples for 45 dollars to Henry and kept 23 apples for herself on Friday. The end of it all."
    same = "The farmer anna sold 12 apples, for 30 euros to peter, and kept 18 apples for herself on monday"
    other = "How many km does a train at 70 kmh go in 6 hours if it stops for 20 minutes at each of 5 stations"
    got = leaks(make, items, [(1, good), (2, other), (3, prose(9, 80)), (4, same)])
    assert got == {(1, 1): True, (2, 5): True, (4, 1): False}


def test_inconsistent_slots_are_let_go(make, spark):
    items = spark.createDataFrame([(1, "we took 5 boxes and then another 5 boxes and put all 5 boxes into the van")], "item_id long, text string")
    assert leaks(make, items, [(1, "we took 7 boxes and then another 7 boxes and put all 7 boxes into the van")]) == {(1, 1): True}
    assert leaks(make, items, [(2, "we took 7 boxes and then another 8 boxes and put all 9 boxes into the van")]) == {}


def test_shuffled_benchmark_gives_the_same(make, items, monkeypatch):
    rows = [(10 + k, prose(k, k) + " " + prose(77, 30, 10**5)) for k in range(6)] + [(1, None), (2, "")]
    want = leaks(make, items, rows)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert leaks(make, items, rows) == want and len(want) == 6


def test_leaks_of_odd_rows(make, items, odd, spark):
    assert leaks(make, items, odd) == {} and leaks(make, items, []) == {}
    kept = decontaminate.without_leaks(make([*odd, (50, prose(77, 30, 10**5))]), items)
    assert kept.count() == len(odd) and kept.columns == make(odd).columns
    assert decontaminate.without_leaks(make(odd), items.limit(0)).count() == len(odd)


@pytest.mark.parametrize("most", [0, 500_000])
def test_leaks_in_null_and_repeated_doc_ids(make, items, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    leak = prose(3, 7) + " " + prose(77, 30, 10**5)
    rows = [(None, leak), (None, prose(4, 60)), (None, None), (5, prose(5, 60)), (5, leak + " end"), (5, leak + " end"), (6, prose(6, 60))]
    assert leaks(make, items, rows) == {(None, 2): False, (5, 2): False}
    kept = [r["text"] for r in decontaminate.without_leaks(make(rows), items).collect()]
    assert prose(6, 60) in kept and not any(t and leak in t for t in kept)


def test_changed_words_and_short_items_are_found(make, spark):
    """Every item of 8 to 60 words, verbatim and with as many words changed as a match may miss, at any alignment."""
    r = random.Random(5)
    texts = {m: [f"q{m}x{k}" for k in range(m)] for m in [*range(8, 32), 45, 60]}
    items = spark.createDataFrame([(m, " ".join(w)) for m, w in texts.items()], "item_id long, text string")
    rows, want = [], set()
    for m, w in texts.items():
        for k in range(6):
            at = prose(m * 10 + k, k)
            rows.append((m * 100 + k, f"{at} {' '.join(w)} {prose(k, 9)}".strip()))
            want.add((m * 100 + k, m))
            for more in (0, 1):
                changed = list(w)
                for i in r.sample(range(m), m // 5 + more):
                    changed[i] = "other"
                rows.append((m * 100 + 10 + 10 * more + k, f"{at} {' '.join(changed)} {prose(k, 9)}".strip()))
                if not more:
                    want.add((m * 100 + 10 + k, m))
    assert set(leaks(make, items, rows)) == want


def brute_leaks(docs, items):
    """{(doc_id, item_id): (word_at, match, reparameterised)}, every item laid at every word of every document."""
    out = {}
    for d, template, raw in docs:
        for i, want, own in items:
            best = None
            for k in range(len(template) if len(want) >= decontaminate.MIN_WORDS else 0):
                match = sum(x == y for x, y in zip(want, template[k : k + len(want)], strict=False)) / len(want)
                slots = [(x.lower(), y.lower()) for t, x, y in zip(want, own, raw[k : k + len(want)], strict=False) if t[0] == "\x01"]
                if match >= decontaminate.MIN_MATCH and len(set(slots)) == len({x for x, _ in slots}) and (best is None or match > best[1]):
                    best = k, match, any(x != y for x, y in slots)
            if best:
                out[d, i] = best
    return out


def test_leaks_of_a_whole_table_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): (r["word_at"], pytest.approx(r["match"]), r["reparameterised"]) for r in decontaminate.leaks(docs, items).collect()}
    words_of = lambda df, key: [tuple(r) for r in df.select(key, decontaminate.templates(decontaminate.F.col("text")), decontaminate.raw_words(decontaminate.F.col("text"))).collect()]
    want, known = {}, words_of(items, "item_id")
    for doc in words_of(docs, "doc_id"):
        # An item of which too few words are anywhere in a document isn't in it.
        held = set(doc[1])
        want |= brute_leaks([doc], [x for x in known if sum(w in held for w in x[1]) >= 0.8 * len(x[1])])
    assert got == want and got


def brute_place(key, weights, rack_shards=4, region_racks=2):
    def draw(level, node, weight):
        h = int(hashlib.md5(f"{key}|{level}|{node}".encode()).hexdigest()[:13], 16)
        return -math.log((h + 0.5) / 2**52) / weight

    racks = [list(range(i, min(i + rack_shards, len(weights)))) for i in range(0, len(weights), rack_shards)]
    regions = [list(range(i, min(i + region_racks, len(racks)))) for i in range(0, len(racks), region_racks)]
    rack_weight = [sum(weights[s] for s in r) for r in racks]
    region = min(range(len(regions)), key=lambda r: draw(0, r, sum(rack_weight[k] for k in regions[r])))
    rack = min(regions[region], key=lambda k: draw(1, k, rack_weight[k]))
    return min(racks[rack], key=lambda s: draw(2, s, weights[s]))


def test_places_against_brute_force(make):
    got = sharding.shard(make([(i * 7919, f"t{i}") for i in range(300)])).collect()
    for r in got:
        assert r["shard"] == brute_place(r["doc_id"], [1.0] * 40) and r["grown_shard"] == brute_place(r["doc_id"], [1.0] * 41)


def test_mixture_against_brute_force(make, monkeypatch):
    """In each source, rows are drawn block by block while the tokens before them are below the quota."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(i, prose(i, 10 + i % 7), "a" if i % 3 else "b") for i in range(200)] + [(900 + i, prose(i, 9), "c") for i in range(12)]
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    got = mixing.draws(make(rows)).collect()
    total = sum(size.values())
    for s in "abc":
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: (r["epoch"], r["at"], r["doc_id"]))
        tokens = sum(size[i] for i in size if source[i] == s)
        quota = mine[0]["weight"] * total
        before = 0
        for epoch in range(max(r["epoch"] for r in mine) + 1):
            part = [r for r in mine if r["epoch"] == epoch]
            # What was drawn stands without gaps from the start of the epoch.
            before = epoch * tokens
            blocks = []
            for r in part:
                assert r["at"] == before < quota
                before += size[r["doc_id"]]
                blocks.append(r["block"])
            assert len([b for b, c in zip(blocks, [None, *blocks], strict=False) if b != c]) == len(set(blocks))
        assert before >= quota or before % tokens == 0


def test_steps_leave_nothing_behind(spark, tmp_path):
    import os

    from terraloom.llm.common import Scratch

    steps = Scratch(spark)
    folder = steps.at.removeprefix("file:")
    one = steps.keep(spark.range(10))
    two = steps.keep(one.where("id > 3"))
    assert (one.count(), two.count()) == (10, 6) and sorted(x for x in os.listdir(folder) if x[0] != ".") == ["1", "2"]
    steps.drop(one)
    assert [x for x in os.listdir(folder) if x[0] != "."] == ["2"] and two.count() == 6
    steps.close()
    assert not os.path.exists(folder)
