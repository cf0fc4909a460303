"""URL rules, sharding and chat formatting beside plain Python."""

import random

import pytest

from txnrisk.llm import ordering, preferences, sharding, url_filters
from txnrisk.llm.queries import RULES

# --- url filters -----------------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def plain_verdict(url, rules, default):
    host, path = plain_parts(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]))
    return host, path, best[0] + best[1], best[2]


def judged(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    rows = url_filters.judge_urls(pages.repartition(3), frame, default=default).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}, len(rows)


def test_contract_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://com", "http://com/", "http://a.com/x", "http://EXAMPLE.com/en/1?q#f",
        "https://www.example.com/en/2", "http://xexample.com/en/3", "http://m.net/es/", "http://net/fr/x", "http://n.net/de/",
        "http://example.com/en", "http://example.com?/en/", "a://b.com/://c", "http://É.com/a", "http://" + "a." * 300 + "com/" + "p" * 5000,
    ] * 2
    got, n = judged(spark, urls, RULES)
    assert n == len(urls)
    assert got == {i: plain_verdict(u, RULES, "allow") for i, u in enumerate(urls)}


def test_nested_rules_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["a", "b", "ab", "c"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))

    def path():
        return "".join(rng.choice(["/", "/a", "/ab", "b"]) for _ in range(rng.randrange(6)))

    rules = {(host(), "/" + path()): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, a) for (h, p), a in rules.items()] + [("c", "", "block")]
    urls = [f"x://{host()}/{path()}" for _ in range(1_500)]
    got, _ = judged(spark, urls, rules, "block")
    assert got == {i: plain_verdict(u, rules, "block") for i, u in enumerate(urls)}


def test_rules_that_repeat_or_hold_nulls(spark):
    rules = [("a", "/", "allow"), ("a", "/", "block"), (None, "/", "block"), ("b", None, "block"), ("b", "/", None)]
    got, _ = judged(spark, ["x://a/", "x://b/"], rules)
    assert got == {0: ("a", "/", "a/", "block"), 1: ("b", "/", None, "allow")}


def test_columns_named_like_internals_and_a_hot_key(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    urls = [f"http://h{i}.com/" for i in range(3000)] + ["https://www.example.com/en/x", None, "ftp://a.net/es/"]
    rows = [(i, u, i % 7, "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, found long, payload string")
    got = url_filters.judge_urls(pages, rules).collect()
    assert len(got) == len(rows) and sorted((r["page_id"], r["found"], r["payload"]) for r in got) == [(i, i % 7, "x") for i in range(len(rows))]
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], RULES, "allow")


def test_no_rules_and_no_pages(spark):
    empty = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "x://a/")], "page_id long, url string")
    assert url_filters.judge_urls(pages, empty).first()["verdict"] == "allow"
    some = spark.createDataFrame(RULES, empty.schema)
    assert url_filters.judge_urls(pages.limit(0), some).count() == 0


# --- sharding --------------------------------------------------------------------------------------


def plain_image(x, n, seed):
    a, b = sharding.sides(n)

    def once(x):
        left, right = divmod(x, b)
        for i, (k0, k1, k2) in enumerate(sharding.round_keys(seed)):
            y = ((left if i % 2 else right) * k0 + k1) % sharding.PRIME
            mixed = (y * y % sharding.PRIME * y + k2) % sharding.PRIME
            left, right = (left, (right + mixed) % b) if i % 2 else ((left + mixed) % a, right)
        return left * b + right

    x = once(x)
    while x >= n:
        x = once(x)
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1_000, 5_003])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(ordering.F.col("id"), n, 11).alias("to")).collect()
    assert sorted(r["to"] for r in rows) == [*range(n)]
    assert all(r["to"] == plain_image(r["id"], n, 11) for r in rows)


@pytest.mark.parametrize("partitions", [1, 9])
def test_shards(spark, partitions):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", None]), 3) for i in range(500)] + [(7, "a", 1)] * 250 + [(None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(partitions)
    got = sharding.assign_shards(frame, ["doc_id", "text"], 24, seed=3).collect()
    order = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        to = plain_image(k, len(rows), 3)
        want.append((i, t, to % 24, to // 24))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    for shard in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == [*range(len(slots))] and len(slots) in (len(rows) // 24, len(rows) // 24 + 1)


def test_shards_keep_columns_named_like_internals(spark):
    names = ["row_no", "tie_break", "slice_no", "first_no", "payload", "o0", "id"]
    rows = [(i, *[i * 10 + k for k in range(len(names))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    got = sharding.assign_shards(frame, ["doc_id"], 24).collect()
    assert sorted(tuple(r[c] for c in ["doc_id", *names]) for r in got) == sorted(rows)
    assert got[0].__fields__[-2:] == ["shard", "slot"]


def test_sharding_of_nothing(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long"), ["doc_id"], 24).count() == 0


# --- chat formatting -------------------------------------------------------------------------------


def plain_turn(role, text):
    return f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"


def plain_completion(turns):
    out, spans = "", []
    for _, role, text in turns:
        head = f"<|im_start|>{role or ''}\n"
        if role == "assistant":
            spans.append((len(out) + len(head), len(out) + len(plain_turn(role, text)) - 1))
        out += plain_turn(role, text)
    return out, spans


def plain_pairs(rows):
    made = {}
    for pair in {r[0] for r in rows if r[0] is not None and r[1] in ("chosen", "rejected")}:
        sides = [
            sorted((r[2:] for r in rows if r[0] == pair and r[1] == s), key=lambda t: tuple((v is None, v or 0 if i == 0 else v or "") for i, v in enumerate(t)))
            for s in ("chosen", "rejected")
        ]
        shared = 0
        while all(len(s) > shared for s in sides) and sides[0][shared][1:] == sides[1][shared][1:]:
            shared += 1
        prompt = "".join(plain_turn(*t[1:]) for t in sides[0][:shared])
        made[pair] = (shared, prompt, *[plain_completion(s[shared:]) for s in sides])
    return made


def test_format_pairs(spark):
    rng = random.Random(3)
    rows = []
    for pair in range(60):
        for side in ("chosen", "rejected"):
            for turn in range(rng.randrange(6)):
                role = rng.choice(["user", "assistant", None, "assistant"])
                rows.append((pair, side, turn, role, rng.choice(["same", "same", "é漢", None, ""])))
    rows += [(None, "chosen", 0, "user", "x"), (1, "other", 0, "user", "x"), (2, "chosen", 0, "user", "tie"), (2, "chosen", 0, "user", "tie")]
    frame = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    got = {
        r["pair_id"]: (
            r["prompt_turns"], r["prompt"],
            (r["chosen"], [tuple(s) for s in r["chosen_spans"]]), (r["rejected"], [tuple(s) for s in r["rejected_spans"]]),
        )
        for r in preferences.format_pairs(frame).collect()
    }
    assert got == plain_pairs(rows)
    assert preferences.format_pairs(frame.limit(0)).count() == 0


def test_echo_pairs(spark):
    talks = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "bye"),
        (2, 0, "assistant", "first"), (3, 0, "user", "alone"), (4, 0, "user", None), (4, 1, "assistant", "x"),
        (None, 0, "user", "n"), (5, None, "user", "n"),
    ]
    frame = spark.createDataFrame([(*t, 1) for t in talks], "conv_id long, turn long, role string, text string, side int")
    got = {(r["pair_id"], r["side"], r["turn"]): r["text"] for r in preferences.echo_pairs(frame).collect()}
    assert got == {
        (1, "chosen", 1): "q", (1, "rejected", 1): "q", (1, "chosen", 2): "a", (1, "rejected", 2): "q",
        (4, "chosen", 1): None, (4, "rejected", 1): None, (4, "chosen", 2): "x", (4, "rejected", 2): None,
    }
