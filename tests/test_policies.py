"""Destinations, holds and knowledge overlays against brute force and planted cases."""

import ipaddress
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import destinations, holds
from plumbline.plans.overlay import Overlay

#: What a resolver reads in each spelling; None is a name or nothing.
SPELLED = {
    "127.0.0.1": "127.0.0.1", "127.1": "127.0.0.1", "2130706433": "127.0.0.1", "0x7f.1": "127.0.0.1", "0177.0.0.1": "127.0.0.1", "0x7F000001": "127.0.0.1", "017700000001": "127.0.0.1",
    "10.65535": "10.0.255.255", "10.65536": "10.1.0.0", "1.2.65535": "1.2.255.255", "1.2.65536": None, "1.2.3.256": None, "256.1": None, "4294967296": None, "1.2.3.4.5": None, "08.1.1.1": None,
    "1..2": None, "": None, ".": None, "0": "0.0.0.0", "0x": "0.0.0.0", "127.0.0.1.": "127.0.0.1", "a.b": None, "1.2.3.x": None, "0xabcdefabcdefabcdef": None,
    "::": "::", "::1": "::1", "1::": "1::", "fe80::1%eth0": "fe80::1", "FE80::A": "fe80::a", "::ffff:10.0.0.1": "::ffff:10.0.0.1", "64:ff9b::1.2.3.4": "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7::": "1:2:3:4:5:6:7:0", "1:2:3:4:5:6:7:8:9": None, "1::2::3": None, ":::": None, ":1": None, "1:": None, "1:2": None, "12345::": None, "g::": None, "::1.2.3": None, "::1.2.3.256": None, "1:2:3:4:5:6:7:1.2.3.4": None,
}


def digits(text):
    ip = ipaddress.ip_address(text)
    return f"{int(ip) + (0xFFFF << 32 if ip.version == 4 else 0):032x}"


def test_every_spelling_is_one_number(spark):
    rows = spark.createDataFrame([(k,) for k in SPELLED], "host string")
    got = {r["host"]: r["a"] for r in rows.select("host", destinations.address(F.col("host")).alias("a")).collect()}
    assert got == {k: v and digits(v) for k, v in SPELLED.items()}


def test_fuzzed_version_6(spark):
    rng = random.Random(6)
    texts = {"".join(rng.choice("01af:.:") for _ in range(rng.randint(2, 18))) for _ in range(4000)}
    texts |= {str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & ~(0xFFFFFFFF << 16 * rng.randint(0, 6)))) for _ in range(500)}
    rows = spark.createDataFrame([(t,) for t in sorted(texts) if ":" in t], "host string")

    def want(text):
        try:
            return digits(text)
        except ValueError:
            return None

    got = {r["host"]: r["a"] for r in rows.select("host", destinations.address(F.col("host")).alias("a")).collect()}
    assert got == {t: want(t) for t in got} and sum(v is not None for v in got.values()) > 500


REFUSED = [
    ("https://sk-abc123@api.example.com/v1", {}, "userinfo"), ("http://api.example.com/v1", {}, "plain_http"), ("https://169.254.169.254/latest", {"allow_private": True, "allow_http": True}, "link_local"),
    ("https://127.0.0.1:8000/v1", {}, "private"), ("https://127.0.0.1:8000/v1", {"allow_private": True}, None), ("https://10.1.2.3/v1", {}, "private"), ("file:///etc/passwd", {}, "scheme"), (None, {}, "scheme"), ("", {}, "scheme"),
    ("https://api.openai.com/v1", {}, None), ("http://localhost:8000/v1", {"allow_http": True, "allow_private": True}, None), ("https://internal.corp/v1", {}, None), ("https://127.1/v1", {"allow_private": True}, "spelling"),
    ("https://xn--80ak6aa92e.com/v1", {}, None), ("https://host.3com/", {}, "spelling"), ("https://user:sk@host:notaport/v1", {}, "unreadable"), ("https:///v1", {}, "no_host"), ("https://[fe80::1%25eth0]/", {}, "spelling"),
    ("https://[FE80::1]:443/", {}, "link_local"), ("https://[ff12::1]/", {}, "link_local"), ("https://[fd00::1]/", {}, "private"), ("https://[::ffff:169.254.1.1]/", {"allow_private": True}, "link_local"), ("https://[2001:db8::1]/", {}, None),
    ("https://172.32.0.1/", {}, None), ("https://172.31.255.255/", {}, "private"), ("https://0.0.0.0/", {}, "private"), ("https://0.0.0.1/", {}, None), ("https://a b/", {}, "unreadable"), ("https://" + "a." * 127 + "com/", {}, "spelling"),
]


def test_destinations_are_refused_for_their_reason(spark):
    for policy in ({}, {"allow_private": True}, {"allow_http": True, "allow_private": True}):
        mine = [(u, r) for u, p, r in REFUSED if p == policy] * 2
        rows = spark.createDataFrame(mine, "url string, want string")
        got = destinations.verdicts(rows, **policy).collect()
        assert len(got) == len(mine) and [(r["url"], r["refusal"]) for r in got if r["refusal"] != r["want"]] == []


def test_the_narrowest_block_counts(spark):
    ranges = destinations.blocks(spark, [("0.0.0.0/0", "all"), ("10.0.0.0/8", "ten"), ("10.9.0.0/17", "nine"), ("10.9.8.7/32", "one"), ("::/0", "six"), ("fc00::/7", "local")])
    hosts = {"10.9.8.7": "one", "10.9.8.8": "nine", "10.9.128.0": "ten", "11.0.0.0": "all", "[fdff::1]": "local", "[fe00::1]": "six", "name.org": None}
    rows = spark.createDataFrame([(h, f"https://{h}/") for h in hosts], "h string, url string")
    assert {r["h"]: r["kind"] for r in destinations.verdicts(rows, ranges=ranges).collect()} == hosts
    assert destinations.verdicts(rows.limit(0)).count() == 0


START = datetime(2026, 10, 21, 7, 0, tzinfo=UTC)


def test_retry_after_in_both_forms(spark):
    date = "Wed, 21 Oct 2026 07:00:28 GMT"
    want = {"7": 7, "+7": 7, "0": 0, "600": 60, "99999999999999": 60, "-1": 5, "": 5, "soon": 5, date: 28, "Wed, 21 Oct 2026 06:00:00 GMT": 0, "Thu, 22 Oct 2026 06:00:00 GMT": 60, "Wed, 99 Oct 2026 06:00:00 GMT": 5}
    rows = spark.createDataFrame([(k, START) for k in [*want, None]], "h string, at timestamp")
    assert {r["h"]: r["w"] / 1e6 for r in rows.select("h", holds.retry_after(F.col("h"), F.col("at")).alias("w")).collect()} == want | {None: 5}


def by_hand(rows):
    """The gate itself, told of each refusal in order of time."""
    until, out = {}, []
    for host, at, wait in sorted(rows):
        if wait <= 0:
            continue
        if host in until and at <= until[host]:
            until[host] = max(until[host], at + wait)
            out[-1] = (host, out[-1][1], until[host], out[-1][3] + 1)
        else:
            until[host] = at + wait
            out.append((host, at, at + wait, 1))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_holds_and_waits_equal_the_gate(spark, seed):
    rng = random.Random(seed)
    hosts = ["hot"] * 6 + ["b", "c"]
    told = [(rng.choice(hosts), rng.randint(0, 900), rng.choice([0, 1, 3, 3, 10, 60])) for _ in range(150)]
    rows = spark.createDataFrame([(h.upper(), START + timedelta(seconds=a), str(w)) for h, a, w in told] + [("b", None, "9")], "host string, at timestamp, retry_after string")
    held = holds.holds(rows)
    seconds = lambda t: round((t.replace(tzinfo=UTC) - START).total_seconds()) if t.tzinfo is None else round((t - START).total_seconds())
    shown = held.select("host", F.unix_seconds("held_from").alias("low"), F.unix_seconds("held_until").alias("high"), "refusals").collect()
    base = int(START.timestamp())
    want = by_hand(told)
    assert sorted((r["host"], r["low"] - base, r["high"] - base, r["refusals"]) for r in shown) == want and seconds(START) == 0
    asked = [(rng.choice(["hot.", "B", "d"]), rng.randint(-5, 1000), i) for i in range(100)]
    requests = spark.createDataFrame([(h, START + timedelta(seconds=a), i) for h, a, i in asked], "host string, at timestamp, i int")
    waited = {r["i"]: r["waited_us"] // 1_000_000 for r in holds.waits(requests, held).collect()}
    assert waited == {i: max([high - a for h2, low, high, _ in want if h2 == h.lower().rstrip(".") and low <= a < high], default=0) for h, a, i in asked}
    assert holds.holds(rows.limit(0)).count() == 0


def test_overlay_leaves_the_base_alone(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b again"), (None, "no key"), (3, "c")], "k int, text string")
    new = lambda *rows: spark.createDataFrame(list(rows), "k int, text string")
    over = Overlay(base, str(tmp_path / "kb"), "k")
    shown = lambda run: sorted((r["k"] or 0, r["text"]) for r in over.view(run).collect())
    plain = sorted((r["k"] or 0, r["text"]) for r in base.collect())
    assert shown("r") == plain
    over.put("r", new((2, "B"), (4, "d")))
    over.remove("r", new((1, "")))
    over.put("other", new((1, "A")))
    assert shown("r") == [(0, "no key"), (2, "B"), (3, "c"), (4, "d")]
    over.put("r", new((1, "a new")))
    assert (1, "a new") in shown("r") and (1, "A") in shown("other")
    asked = spark.createDataFrame([("r", 2), ("r", 9), ("other", 2), ("other", 1), ("none", 3), ("r", None)], "run_id string, key int")
    got = {(r["run_id"], r["key"]): r["row"] and r["row"]["text"] for r in over.lookup(asked).collect()}
    assert got.pop(("other", 2)) in ("b", "b again")
    assert got == {("r", 2): "B", ("r", 9): None, ("other", 1): "A", ("none", 3): "c", ("r", None): None}
    totals = {r["run_id"]: (r["n"], r["total"]) for r in over.totals(F.length("text")).collect()}
    assert totals == {run: (over.view(run).count(), sum(len(t) for _, t in shown(run))) for run in ("r", "other")}
    over.rollback("r")
    assert shown("r") == plain and (1, "A") in shown("other")
    over.put("r", new((7, "later")))
    assert shown("r") == sorted([*plain, (7, "later")])
    with pytest.raises(ValueError), over.session("s") as before:
        over.put("s", new((5, "e")))
        assert before.count() == 5 and len(shown("s")) == 6
        raise ValueError
    assert shown("s") == plain
    with pytest.raises(Exception, match="no key"):
        over.put("r", new((None, "x")))
