"""Suspect evidence (decomposed, no fan-out join) vs. a literal nested-loop
evaluation of the definition over random small tables."""

import random
from collections import defaultdict

import pytest
from helpers import CODES, make_catalog, ts

from blotter.operators.suspects import suspect_counts, suspect_evidence

ROLE_TYPES = ["S", "so", "SP", "V", "S/O", None]
REL_CODES = ["SU", "OF", "VI", "S", "O", "susp", "OFFX", None]


def brute(incidents, people, roles, arrests):
    role_desc = dict(CODES["role_codes"])
    rel_desc = {(t, c): d for t, c, d in CODES["ejs_codes"]}
    inc = {i[0]: i for i in incidents}
    out = defaultdict(lambda: defaultdict(int))
    suspects = defaultdict(set)
    up = lambda x: (x or "").upper()
    for pp in people:
        per_id, iid, person, rtype, rcode, suspus = pp
        if iid not in inc:
            continue
        _, report, agency, _ = inc[iid]
        rr = [r for r in roles if r[0] == per_id] or [(per_id, None)]
        aa = [a for a in arrests if a[3] == report and a[2] == agency and a[5] == person
              and report is not None and agency is not None and person is not None] or [None]
        rd = rel_desc.get((rtype, rcode))
        for r in rr:
            rdesc = role_desc.get(r[1])
            t_type = up(r[1]) in ("S", "SO", "S/O")
            t_desc = "SUSPECT" in up(rdesc) or "OFFENDER" in up(rdesc)
            t_sus, t_off = "SUSPECT" in up(rd), "OFFENDER" in up(rd)
            t_code = up(rcode) in ("S", "O", "SO", "S/O") or "SUS" in up(rcode) or "OFF" in up(rcode)
            t_suspus = suspus is not None
            if not (t_type or t_desc or t_sus or t_off or t_code or t_suspus):
                continue
            for a in aa:
                o = out[iid]
                o["matched_role_type_rows"] += t_type
                o["matched_role_desc_rows"] += t_desc
                o["matched_suspect_rows"] += t_sus
                o["matched_offender_rows"] += t_off
                o["matched_suspus_rows"] += t_suspus
                o["matched_relation_code_rows"] += t_code
                aid = None if a is None else a[0]
                o["excluded_arrest_rows"] += aid is not None
                if aid is None:
                    suspects[iid].add(per_id)
    return {i: dict(v, suspect_count=len(suspects[i])) for i, v in out.items()}


def random_tables(seed):
    rnd = random.Random(seed)
    incidents = [(i, rnd.choice(["R1", "R2", "R3", None]), rnd.choice(["TN0830400", "X"]),
                  ts(1998, 1, 1)) for i in range(1, 16)]
    people = [(rnd.randint(1, 40), rnd.randint(1, 17), rnd.choice([1, 2, 3, None]), "REL",
               rnd.choice(REL_CODES), rnd.choice([None, None, "A"])) for _ in range(70)]
    roles = [(rnd.randint(1, 40), rnd.choice(ROLE_TYPES)) for _ in range(60)]
    arrests = [(rnd.choice([rnd.randint(1, 9), None]), "A", rnd.choice(["TN0830400", "X"]),
                rnd.choice(["R1", "R2", None]), ts(1998, 1, 2), rnd.choice([1, 2, 3]))
               for _ in range(12)]
    return incidents, people, roles, arrests


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_evidence_matches_bruteforce(spark, seed):
    incidents, people, roles, arrests = random_tables(seed)
    cat = make_catalog(spark, incidents=incidents, incident_people=people,
                       incident_person_roles=roles, arrests=arrests)
    expect = brute(incidents, people, roles, arrests)
    got = {r["incident_id"]: {k: v for k, v in r.asDict().items() if k != "incident_id"}
           for r in suspect_evidence(cat).collect()}
    assert got == expect
    counts = {r["incident_id"]: r["suspect_count"] for r in suspect_counts(cat).collect()}
    assert counts == {i: v["suspect_count"] for i, v in expect.items() if v["suspect_count"]}


def test_text_lists_match_python(spark):
    """ordered_set_text / ordered_list_text vs. sorted-join in plain Python."""
    from blotter.functions.text import ordered_list_text, ordered_set_text
    rnd = random.Random(7)
    words = ["b", "a", "B", "aa", "a b", "10", "2", None]
    data = [(g, rnd.choice(words)) for g in range(300) for _ in range(rnd.randint(0, 6))]
    df = spark.createDataFrame(data, "g int, v string")
    got = {r["g"]: (r["s"], r["l"]) for r in df.groupBy("g").agg(
        ordered_set_text("v", ", ").alias("s"), ordered_list_text("v", " | ").alias("l")).collect()}
    groups = defaultdict(list)
    for g, v in data:
        groups[g].append(v)
    for g, vals in groups.items():
        present = [v for v in vals if v is not None]
        want_set = ", ".join(sorted(set(present))) or None
        want_list = " | ".join(sorted(present)) or None
        assert got[g] == (want_set, want_list), (g, vals)
