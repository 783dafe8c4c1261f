"""The safety axis from written crime and population tables."""

import random

from townrisk import constants as K
from townrisk.plans import crime_measures as M

HEAD = "地域コード,地域,町丁別地域階層,町丁別地域,人口／総数(人),世帯数(世帯)\n"


def crime_table(path, rows):
    """rows: (area name, {kind: count}); a kind that isn't given is an empty cell."""
    lines = [",".join(("市区町丁", *M.COUNTED))]
    lines += [",".join([name, *(str(counts.get(k, "")) for k in M.COUNTED)]) for name, counts in rows]
    path.write_bytes(("\n".join(lines) + "\n").encode("cp932"))
    return str(path)


def rate(n, pop, years, everything, person_years):
    prior = K.PRIOR_EVENTS
    return (n + prior) / (pop * years + prior * person_years / everything) * 1000


def scores(rates):
    """100 * share of rated areas whose rate is the same or higher."""
    known = [r for r in rates.values() if r is not None]
    return {k: None if r is None else 100 * sum(x >= r - 1e-12 for x in known) / len(known) for k, r in rates.items()}


def test_groups():
    assert (len(K.VIOLENT), len(K.BURGLARY), len(K.DAILY_THEFTS), len(K.VISITOR_CRIMES)) == (7, 3, 7, 3)
    assert len(M.COUNTED) == 20 and len(K.CRIME_MEASURES) == 13


def test_from_files(spark, tmp_path):
    rng = random.Random(9)
    towns = [f"丸の内{i}丁目" for i in range(1, 31)]
    pops = {t: rng.choice((12, 99, 100, 340, 5000)) for t in towns}
    counts = {y: {t: {k: rng.randrange(6) for k in M.COUNTED if rng.random() < 0.7} for t in towns if rng.random() < 0.8} for y in (7, 6)}
    rows = {y: [(f"千代田区{t}", c) for t, c in counts[y].items()] + [("千代田区計", {K.VIOLENT[0]: 99})] for y in counts}
    rows[6].append((f"千代田区{towns[0]}", {K.BURGLARY[0]: 3}))  # a key that stands twice counts once per row, no more
    p = tmp_path / "pop.csv"
    p.write_text("\ufeff" + HEAD + "".join(f"13101,千代田区,1,{t},{pops[t]},1\n" for t in towns), encoding="utf-8")
    made = M.from_files(spark, crime_table(tmp_path / "r7.csv", rows[7]), crime_table(tmp_path / "r6.csv", rows[6]), str(p))
    got = {r["town"]: r for r in made.collect()}
    assert set(got) == set(towns)

    def total(y, t, kinds):
        return sum(c.get(k, 0) for name, c in rows[y] if name == f"千代田区{t}" for k in kinds)

    for t in towns:
        for name, kinds in (M.GROUPS | K.CRIME_MEASURES).items():
            assert got[t][name] == total(7, t, kinds), (t, name)
    hard = K.VIOLENT + K.BURGLARY
    serious = {t: total(7, t, hard) + total(6, t, hard) for t in towns}
    daily = {t: total(7, t, K.DAILY_THEFTS) for t in towns}
    assert {t: r["serious"] for t, r in got.items()} == serious
    want = {}
    for name, n, years in (("serious", serious, 2), ("daily", daily, 1)):
        everything, person_years = sum(n.values()), sum(pops.values()) * years
        want[name] = scores({t: rate(n[t], pops[t], years, everything, person_years) if pops[t] >= 100 else None for t in towns})
    for t in towns:
        if pops[t] < 100:
            assert got[t]["safety_score"] is None
        else:
            assert abs(got[t]["safety_score"] - 0.65 * want["serious"][t] - 0.35 * want["daily"][t]) < 1e-6
    mart = M.crime_mart(made)
    assert len(mart.columns) == 18 and mart.count() == len(towns)
    facts = {r["idx"]: r["value"] for r in M.safety_evidence(made).where("key = '千代田区|%s'" % towns[1]).collect()}
    assert facts[0] == str(serious[towns[1]]) and facts[6] == f"{pops[towns[1]]:,}" and len(facts) == 7
