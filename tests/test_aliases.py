import random

from structura.operators import aliases

SCHEMA = "project string, name string, target string"


def expected(rows):
    """Each name's way, step by step."""
    to = {}
    for p, n, t in rows:
        if n is not None and t is not None:
            to[p, n] = min(to.get((p, n), t), t)
    out = {}
    for p, n in to:
        at, hops, seen = n, 0, set()
        while (p, at) in to and at not in seen:
            seen.add(at)
            at, hops = to[p, at], hops + 1
        out[p, n] = (None, None, True) if at in seen else (at, hops, False)
    return out


def test_contracted_chains_are_those_step_by_step(spark, monkeypatch):
    rng = random.Random(7)
    line = [f"x{k}" for k in rng.sample(range(400), 400)]
    rows = [("line", a, b) for a, b in zip(line, line[1:])] + [("star", f"s{k}", "hub") for k in range(60)] + [("star", "hub", "end")]
    rows += [("ring", line[k], line[(k + 1) % 90]) for k in range(90)] + [("ring", f"r{k}", line[k % 90]) for k in range(40)] + [("own", f"o{k}", f"o{k}") for k in range(30)] + [("own", "p", "o3")]
    rows += [("any", f"a{k}", f"a{rng.randrange(200)}") for k in range(150)] + [("tree", f"t{k}", f"t{k // 2}") for k in range(1, 200)] + [("tie", "a", "z"), ("tie", "a", "b"), ("none", "a", None), ("none", None, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    for few in (0, 50):
        monkeypatch.setattr(aliases, "FEW", few, raising=False)
        got = {(r.project, r.name): (r.final, r.hops, r.cyclic) for r in aliases.follow(df, ["project"]).collect()}
        assert got == expected(rows)
    assert aliases.follow(df.limit(0), ["project"]).isEmpty()


def test_rounds_move_a_few_times_the_names(spark, monkeypatch):
    """Doubling wrote a chain of 1,000 names ten times over; contracted, the rounds write each name a few times."""
    written = []
    for method in ("keep", "step"):
        def kept(self, df, own=getattr(aliases.Rounds, method)):
            out = own(self, df)
            written.append(out.count())
            return out

        monkeypatch.setattr(aliases.Rounds, method, kept)
    names = [f"x{k}" for k in random.Random(8).sample(range(1000), 1000)]
    chain = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])], "name string, target string")
    monkeypatch.setattr(aliases, "FEW", 20, raising=False)
    got = aliases.follow(chain)
    assert got.count() == 999 and got.where("final <> '" + names[-1] + "' or cyclic").isEmpty()
    assert sum(written) < 7 * 999  # 1 for names, 4 for levels, 1 for what comes back, few for the rest
