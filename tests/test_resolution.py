"""Ordered rules and longest prefixes against plain versions, on many rules, contexts and ranges."""

import random

from provena.operators import resolve


def plain_rule(name, context, rules):
    ctx = context or ""
    fits = [r for r in rules if r[1] == name and (r[0] in ("exact", "default") or (r[0] == "context" and r[2] is not None and r[2] in ctx) or (r[0] == "pair" and r[2] == ctx))]
    if not fits:
        return None, "unresolved"
    _, _, _, value, _, vague = min(fits, key=lambda r: (r[4], r[0], r[2] or "", r[3] or ""))
    return (None, "ambiguous") if vague else (value, "resolved" if value is not None else "unresolved")


def test_rules_against_a_loop(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abن") for _ in range(n))
    rules, n = [], 0
    for name in ("sufyan", "hisham", "amr"):
        for kind, count in (("context", 60), ("pair", 10), ("exact", name == "amr"), ("default", 1)):
            for _ in range(count):
                n += 1
                pattern = rng.choice([text(rng.randrange(0, 7)), None]) if kind in ("context", "pair") else None
                rules.append((kind, name, pattern, rng.choice([None, f"id{n}", f"id{n}"]), {"pair": n % 50, "context": n % 90, "exact": 70, "default": 99}[kind], rng.random() < 0.1))
    rules.append(("context", "none", "x", "y", 1, False))
    mentions = [(rng.choice(["sufyan", "hisham", "amr", "other", None]), rng.choice([None, "", text(rng.randrange(12)), text(rng.randrange(12))])) for _ in range(400)]
    r = spark.createDataFrame(rules, "kind string, name string, pattern string, value string, priority int, ambiguous boolean")
    got = resolve.apply_rules(spark.createDataFrame(mentions, "name string, context string"), r).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted((tuple(x) for x in got), key=key) == sorted(((m, c, *plain_rule(m, c, rules)) for m, c in mentions), key=key)


def test_many_rules_of_one_name_are_not_tried_one_by_one(spark):
    r = spark.range(10_000).selectExpr("'context' AS kind", "'sufyan' AS name", "concat('<', lpad(id, 5, '0'), '>') AS pattern", "cast(id AS string) AS value", "cast(id AS int) AS priority", "false AS ambiguous")
    m = spark.range(2000).selectExpr("'sufyan' AS name", "concat('told by <', lpad(id * 5, 5, '0'), '> in town') AS context", "cast(id * 5 AS string) AS want")
    work: dict = {}
    assert resolve.apply_rules(m, r, work=work).where("value = want AND status = 'resolved'").count() == 2000
    assert work["pairs"] == 2000 and work["candidates"] < 60 * work["pairs"]  # of 10,000 rules


def test_open_prefixes_in_every_range(spark):
    rng = random.Random(2)
    token = lambda: rng.choice(["محمد", "محمد", "محمد", "بن", "ا", "a", "aa", "a-b", "z", "\U0001f600"])
    name = lambda n: " ".join(token() for _ in range(rng.randrange(1, n)))
    names, known = {name(9) for _ in range(400)}, {name(5): rng.random() < 0.3 for _ in range(150)}
    n, k = spark.createDataFrame([(x,) for x in names], "key string"), spark.createDataFrame(list(known.items()), "key string, sure boolean")
    want_all = {x: [" ".join(x.split(" ")[:i]) for i in range(len(x.split(" ")), 0, -1) if " ".join(x.split(" ")[:i]) in known] for x in names}
    for parts in (1, 7, 60):
        got: dict = {}
        for r in resolve.open_prefixes(n, k, parts).collect():
            assert r["rank"] == r["key"].count(" ") - r["prefix"].count(" ")
            got.setdefault(r["key"], []).append((r["rank"], r["prefix"]))
        for x, prefixes in want_all.items():
            mine = [p for _, p in sorted(got.get(x, []))]
            assert len(mine) == len(set(mine)) and set(mine) <= set(prefixes)
            sure = next((i for i, p in enumerate(prefixes) if known[p]), len(prefixes))
            assert mine[: sure + 1] == prefixes[: sure + 1], (x, parts)
    assert resolve.open_prefixes(n.limit(0), k, 3).count() == 0 and resolve.open_prefixes(n, k.limit(0), 3).count() == 0
