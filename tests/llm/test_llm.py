"""Text and name operators: brute force, exact round trips, planted pages."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tieout.llm import mixing, name_tokens, names, stuffing, tokenize

# -------------------------------------------------------------- tokens


def edits(a, b):
    """Plain optimal string alignment distance."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_equals_the_plain_one():
    rng = random.Random(1)
    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert name_tokens.distance(a, b) == min(edits(a, b), 4)


def test_delete_index_finds_every_near_token(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    variants = []
    for b in base:
        i, j = sorted(rng.sample(range(len(b)), 2))
        variants += [b[:i] + b[i + 1 :], b[:i] + "z" + b[i:], b[:i] + "z" + b[i + 1 :], b[:i] + b[i + 1 : j] + b[j + 1 :]]
    df = spark.createDataFrame([(b, 100) for b in dict.fromkeys(base)] + [(v, 1) for v in dict.fromkeys(variants) if v not in base], "token string, n long")
    got = {}
    for r in names.token_bases(df).collect():
        got.setdefault(r.token, set()).add(r.base)
    for v in variants:
        near = {b: edits(v, b) for b in base}
        best = min(near.values())
        assert v in got[v]
        if best <= 2 and v not in base:
            assert {b for b, d in near.items() if d == best} & got[v], (v, got[v])


def test_rare_spellings_are_neighbours_of_each_other_and_of_farther_names(spark):
    df = spark.createDataFrame([("QUIBBLE", 1), ("QUIBLE", 1), ("SHARD", 2), ("SHORD", 5), ("SNORD", 9)], "token string, n long")
    got = {(r.token, r.base) for r in names.token_bases(df).collect() if r.token != r.base}
    assert got == {("QUIBLE", "QUIBBLE"), ("SHARD", "SHORD"), ("SHORD", "SNORD"), ("SHARD", "SNORD")}


def test_neighbours_are_never_sent_to_the_driver(spark):
    rng = random.Random(14)
    tokens = {"".join(rng.choice("ABCDEFGH") for _ in range(8)) for _ in range(300)}
    bases = names.token_bases(spark.createDataFrame([(t, 1) for t in tokens], "token string, n long"))
    bases.collect()
    assert "BroadcastHashJoin" not in bases._jdf.queryExecution().executedPlan().toString()


def test_assignment_equals_trying_all():
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(200):
        a, b = (tuple(range(rng.randint(0, 5))) for _ in range(2))
        w = {(x, y): rng.choice([0, 0, 1, 2, 3.5]) for x in a for y in b}
        few, many, key = (a, b, lambda x, y: w[x, y]) if len(a) <= len(b) else (b, a, lambda x, y: w[y, x])
        best = max(sum(key(x, y) for x, y in zip(few, p)) for p in permutations(many, len(few)))
        met = name_tokens.matched(a, b, lambda x, y: w[x, y])
        assert sum(w[a[i], b[j]] for i, j in met) == best and len({i for i, _ in met}) == len({j for _, j in met}) == len(met)


@pytest.mark.parametrize(("a", "b", "same"), [("O'NEIL, JAMES T", "james t oneil", True), ("SMITHERS, PEGGY", "SMITHRES, MARGARET MRS", True), ("SMITHERS, M", "Smithers / Margaret", True), ("SMITHERS, ALAN", "SMITHERS, SUSAN", False), ("SMITHERS, A", "SMITHERS, SUSAN", False), ("VAN DER BERGEN, JO", "VANDERBERGEN, JOHN", True), ("LONGMORE-HALL, ANNE", "LONGMORE, ANNE", True), ("LONGMORE, JOHN", "HALLBURY, JOHN", False), ("VAN DER MOSTWICK, ANNE", "Mostwick, Ann", True), ("V D MOSTWICK, ANNE", "VANDERMOSTWICK, ANNE", True), ("SMITHERS, JAMES ROBERT", "SMITHERS, ROBERT J", True), ("SMITHERS, JECNN", "SMITHERS, JENNIFER", True), ("SMITHERS, JOHN S", "SMITHERS, SUSAN", False)])
def test_people_align(a, b, same):
    surname, given, *_ = name_tokens.align_people(a, b)
    assert bool(surname and given) is same
    assert name_tokens.align_people(b, a)[:2] == (surname, given)


@pytest.mark.parametrize(("a", "b", "same"), [("The Bixby & Dale Chemicals Ltd", "BIXBY AND DALE CHEMS. LIMITED", True), ("Chemicals (Bixby Dale) plc", "Bixby Dale Chemicals", True), ("Bixby Dale Chemicals Ltd", "Bixby Dale Catering Ltd", False), ("Bixby Dale Chemicals (North) Ltd", "Bixby Dale Chemicals (South) Ltd", False), ("Bixby Dale Chemicals (North) Ltd", "Bixby Dale Chemicals Ltd", False), ("Bixby Dale Plan 1975", "Bixby Dale Plan 1976", False), ("Bixbby Dale Plan 1975", "Bixby Dale Plan/1975", True)])
def test_companies_align(a, b, same):
    common = frozenset({"north", "south", "chemicals", "catering", "plan"})
    x, y = name_tokens.company(a), name_tokens.company(b)
    assert (len(name_tokens.assign(x, y, common)[0]) == len(x) == len(y)) is same


PEOPLE = "id string, name string, born string, number string, place string"


def _background(n):
    rng = random.Random(9)
    syl = ["BLA", "KOR", "MIN", "TES", "VUR", "NEL", "SHA", "PEK", "DOM", "LIR"]
    return [(f"z{i:05d}", f"{''.join(rng.sample(syl, 3))}, {rng.choice(['JOHN', 'SUSAN', 'IMRAN', 'GWEN'])}", (date(1940, 1, 1) + timedelta(days=rng.randrange(20000))).strftime("%Y%m%d"), None, f"P{i}") for i in range(n)]


def test_people_are_linked_by_evidence_not_by_name_alone(spark):
    people = [
        ("a1", "QUIBBLETON, MARGARET", "19500102", "AB123456C", "X1"), ("a2", "Quibleton, Peggy", "19500102", None, "X1"), ("a3", "QUIBBLETON, M", "19500201", "AB123456C", "X9"), ("a4", "QUIBBLETON, MARGARET", "19500102", None, "X7"),
        ("b1", "QUIBBLETON, JOHN", "19500102", "CD123456C", "X1"),  # a twin
        ("c1", "QUIBBLETON, MARGARET", "19770707", "EF123456C", "X1"),  # a namesake of another generation
        ("d1", None, "19500102", "AB123456C", "X1"), ("d2", "  ", "19500102", None, "X1"),
    ]
    df = spark.createDataFrame(people + _background(400) + people[:1], PEOPLE)
    e = names.entities(names.person_links(df))
    pairs = {tuple(r) for r in names.variant_pairs(e, df.select("id", "name")).collect()}
    assert {p for p in pairs if p[0] < "e"} == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4")}  # a1 and a4 are recorded alike


def test_placeholders_identify_nobody_and_common_names_need_more(spark):
    rows = [(f"n{i:04d}", f"NAME{chr(65 + i % 26)}{chr(65 + i // 26 % 26)}SON, JOHN", f"19{50 + i % 40}0101", "ZZ999999A", None) for i in range(200)]
    # without a number anywhere only the limit beforehand decides
    rows += [(f"s{i:04d}", "SMITHERSON, JOHN" if i % 2 else "Smitherson, J", "19600606", None, f"Q{i}") for i in range(60)]
    got = names.person_links(spark.createDataFrame(rows, PEOPLE))
    assert got.count() == 0


def test_holders_of_a_placeholder_meet_by_name_and_birth_date(spark):
    rows = [(i, n, b, "ZZ999999A", p) for i, n, b, _, p in _background(60)]
    rows += [("a1", "QUIBBLETON, MARGARET", "19500102", "ZZ999999A", "X1"), ("a2", "Quibbleton, Peggy", "19500102", "ZZ999999A", "X2"), ("a3", "QUIBBLETON, PEGGY", "19500102", "AB123456C", "X3"), ("a4", "QUIBBLETON, JOHN", "19500102", "ZZ999999A", "X4")]
    people = spark.createDataFrame(rows + [(f"y{i}", *r) for i, *r in _background(400)], PEOPLE)
    assert {tuple(r) for r in names.person_links(people).collect() if r.a < "y"} == {("a1", "a2"), ("a1", "a3"), ("a2", "a3")}


def test_values_of_many_policies_still_link_their_person(spark):
    rows = [(f"p{i:02d}", "QUIBBLETON, MARGARET" if i % 2 else "Quibbleton, Peggy", "19510102" if i == 43 else None if i == 44 else "19500102", "AB123456C", f"X{i}") for i in range(45)]
    rows += [("r1", "FROSTERLEY, GWEN", "19600303", "CD123456C", None), ("r2", "Frosterley, G", "19610303", "CD123456C", None)] * 24  # few policies, delivered often
    rows += [(f"y{i}", n, b, None, "HOT") for i, n, b, _, _ in _background(60)]
    rows += [("q1", "WIBBLETHORP, SUSAN", "19700405", None, "HOT"), ("q2", "Wibblethorp, Sue", "19700504", None, "HOT"), ("q3", "WIBBLETHORP, JOHN", "19700405", None, "HOT")]
    links = names.person_links(spark.createDataFrame(rows + _background(8000), PEOPLE)).where("a < 'y'")
    of = {r.id: r.entity for r in names.entities(links).collect()}
    assert of == {f"p{i:02d}": "p00" for i in range(45)} | {"r1": "r1", "r2": "r1", "q1": "q1", "q2": "q1"}


def _links(spark, rows):
    return {tuple(r) for r in names.person_links(spark.createDataFrame(rows, PEOPLE)).collect()}


def test_many_of_one_surname_and_birth_date_or_number_all_meet(spark):
    # a hundred of one surname born on one day; the couples' given names are rare, and two of them have equal numbers
    rows = [(f"y{i:03d}", "SMITHERSON, JOHN", "20010101", None, f"X{i}") for i in range(100)]
    rows += [("a1", "SMITHERSON, QUILLA ZORA", "20010101", "AB123456C", "A1"), ("a2", "Smitherson, Quilla Z", "20010101", "AB123456C", "A2"), ("b1", "SMITHERSON, XANTHE VERITY", "20010101", "CD123456C", "B1"), ("b2", "Smitherson, Xanthe V", "20010101", "CD123456C", "B2")]
    rows += [("c1", "SMITHERSON, WILFRIDA UNITY", "20010101", "EF123456C", "C1"), ("c2", "Smitherson, Wilfrida U", "20010101", None, "C2")]
    assert {p for p in _links(spark, rows + _background(500)) if p[0] < "d"} == {("a1", "a2"), ("b1", "b2"), ("c1", "c2")}
    # one person's number with more records than SPLIT: one has no birth date, one another surname, one a slip in the number besides
    rows = [(f"p{i:02d}", "QUIBBLETON, MARGARET", "19500102", "AB123456C", f"X{i}") for i in range(90)]
    rows += [("q1", "Quibbleton, Peggy", None, "AB123456C", "Y1"), ("q2", "FROSTERLEY, MARGARET", "19500102", "AB123456C", "Y2"), ("q3", "QUIBBLETON, MARGARET", "19510102", "AB124356C", "Y3")]
    people = spark.createDataFrame(rows + _background(200), PEOPLE)
    of = {r.id: r.entity for r in names.entities(names.person_links(people)).collect() if r.id < "r"}
    assert of == {r[0]: "p00" for r in rows}


def test_many_of_one_postcode_meet_by_birth_date_alone(spark):
    # the surnames are three slips apart, which no base reaches
    rows = [(f"y{i}", n, b, None, "HOT") for i, n, b, _, _ in _background(80)]
    rows += [("a1", "QUIBBLETHORNLEY, MARGARET", "19500102", None, "HOT"), ("a2", "QWIBLETHORNLAY, MARGARET", "19500102", None, "HOT")]
    assert {p for p in _links(spark, rows + _background(400)) if p[0] < "y"} == {("a1", "a2")}


def test_holders_of_a_placeholder_without_a_birth_date_meet(spark):
    # so many share placeholder and surname that they once didn't meet; the initial is rare
    rows = [(f"y{i:03d}", "SMITHERSON, JOHN", f"19{30 + i % 60}{1 + i % 12:02d}01", "ZZ999999A", f"X{i}") for i in range(200)]
    rows += [("a1", "SMITHERSON, QUILLA ZORA", "19500102", "ZZ999999A", "X1"), ("a2", "Smitherson, Q Z", None, "ZZ999999A", "X2")]
    people = spark.createDataFrame([(*r,) for r in rows + _background(400)], PEOPLE)
    met = []
    judge = names._believed

    def spied(judged, *rest):
        met.extend((r.tally, r.sure, r.given) for r in judged.where("given = 'Q'").collect())
        return judge(judged, *rest)

    names._believed = spied
    try:
        names.person_links(people).count()
    finally:
        names._believed = judge
    assert met == [(None, False, "Q")]


def test_a_mistyped_number_and_many_middle_names(spark):
    rows = [("a1", "QUIBBLETON, MARGARET", "19500102", "AB123456C", "X1"), ("a2", "QUIBBLETON, MARGARET ANN", "19500102", "AB124356C", "X2"), ("a3", "QUIBBLETON, MARGARET", "19510102", "AB12356C", "X3")]
    rows += [("b1", "FROSTERLEY, GWEN A B C D E F", "19600303", None, "Y1"), ("b2", "FROSTERLEY, GWEN F", "19600303", None, "Y1"), ("b3", "FROSTERLEY, GWEN Z", "19630303", None, "Y1")]
    assert {p for p in _links(spark, rows + _background(400)) if p[0] < "z"} == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("b1", "b2")}
    # a birth date a year off beside a slip in the number: only the index of numbers lets them meet
    rows = [("a1", "QUIBBLETON, MARGARET", "19500102", "AB123456C", "X1"), ("a2", "QUIBBLETON, MARGARET", "19510102", "AB123465C", "X2")]
    assert ("a1", "a2") in _links(spark, rows + _background(400))


def test_two_spellings_seen_once(spark):
    rows = [("a1", "QUIBBLETHORN, MARGARET", "19500102", None, "X1"), ("a2", "QUIBLETHROM, MARGARET", "19500102", None, "X1")]
    assert ("a1", "a2") in _links(spark, rows + _background(400))


def test_hot_values_keep_true_links_without_gathering_their_holders(spark, monkeypatch):
    n = 3000
    rows = [(i, a, b if k % 3 else "20010101", "AB999999A" if k % 3 == 1 else None, "HOT" if k % 3 == 2 else f"P{i}") for k, (i, a, b, _, _) in enumerate(_background(n))]
    rows += [("a1", "QUIBBLETON, MARGARET", "19500102", "AB999999A", "X1"), ("a2", "Quibbleton, Peggy", "19500102", "AB999999A", "X2"), ("b1", "WIBBLETHORP, SUSAN", "19700405", None, "HOT"), ("b2", "Wibblethorp, Sue", "19700504", None, "HOT")]
    biggest = []
    pairs = names._pairs

    def spied(keyed):
        biggest.append(keyed.distinct().groupBy("key").count().agg(F.max("count")).first()[0])
        return pairs(keyed)

    monkeypatch.setattr(names, "_pairs", spied)
    assert {p for p in _links(spark, rows) if p[0] < "z"} == {("a1", "a2"), ("b1", "b2")}
    assert biggest[0] <= names.SPLIT


@pytest.mark.parametrize("n", [1500, 9000])
def test_recall_of_seeded_variants_at_two_sizes(spark, n):
    rng = random.Random(n)
    rows, truth = [], set()
    for k, (i, name, born, _, place) in enumerate(_background(n)):
        rows.append((i, name, born, f"AB{k:06d}C", place))
        if k % 5 == 0:
            at = rng.randrange(1, 7)
            slip = name[:at] + rng.choice(["", name[at] * 2, "Q"]) + name[at + 1 :]
            how = rng.choice(["number", "place", "name"])
            rows.append((f"x{i}", slip if how != "name" else name.lower(), born, f"AB{k:06d}C" if how == "number" else None, place if how == "place" else f"R{k}"))
            truth.add((f"x{i}", i))
    got = _links(spark, rows)
    found = {tuple(sorted(p)) for p in got}
    assert len(truth & found) >= 0.985 * len(truth) and len(truth & found) >= 0.985 * len(found)


def test_organisations_of_common_words_and_equal_names(spark):
    words = "north south east west plan fund works steel glass paper".split()
    rng = random.Random(5)
    rows = [(f"o{i:03d}", " ".join(rng.sample(words, 4)).title()) for i in range(60)] + [("q1", "North Steel Works Ltd"), ("q2", "Works North Steel"), ("q3", "North Steel Works Ltd"), ("q4", "North Glass Works"), ("n", None), ("e", " ")]
    df = spark.createDataFrame(rows, "id string, name string")
    of = {r.id: r.entity for r in names.entities(names.organisation_links(df, frozenset(words))).collect()}
    assert {k: v for k, v in of.items() if k > "q"} == {"q1": "q1", "q2": "q1", "q3": "q1"}


def test_no_people_no_links(spark):
    none = spark.createDataFrame([], PEOPLE)
    assert names.variant_pairs(names.entities(names.person_links(none)), none.select("id", "name")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(f"{rng.randrange(60):02d}", f"{rng.randrange(60):02d}") for _ in range(45)] + [(f"L{i:03d}", f"L{i + 1:03d}") for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.entity for r in names.entities(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


# ------------------------------------------------------------ encoding

TEXTS = [None, "", " ", "a  b", "<|endoftext|> it's", "naïve 👩‍⚖️ café\x1c\x85　end", "word " * 60_000, "x" * 300_000, "line\n\n\n  end   " * 9_000, "don't 'LL 123abc!?\t" * 8_000, "\n" * 100_000 + "a"]


def test_ids_of_long_texts_equal_those_of_the_whole(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    e = tokenize.encoder()
    got = {r.doc_id: r.ids for r in tokenize.token_ids(df.withColumn("ids", F.lit(1))).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (e.encode_ordinary(t) if t else [])
    assert tokenize.round_trips(df).where("not exact").count() == 0
    assert tokenize.token_ids(df.limit(0)).count() == 0


def test_pieces_join_to_the_text_and_are_cut_safely():
    rng = random.Random(6)
    e = tokenize.encoder()
    for _ in range(150):
        t = "".join(rng.choice(["a", "b1", " ", "  ", "\n", "'s", "!", "é", ".", "\t", " "]) for _ in range(200))
        ps = tokenize.pieces(t, 20)
        assert "".join(ps) == t and [i for p in ps for i in e.encode_ordinary(p)] == e.encode_ordinary(t)


# -------------------------------------------------------------- mixing


def _mix(spark, counts, weights):
    c = spark.createDataFrame(counts, "doc_id long, source string, n_tokens long")
    w = spark.createDataFrame(weights, "source string, target_share double, max_repeats int")
    p = mixing.plan(c, w)
    return c, w, p


def test_shares_caps_and_positions(spark):
    rng = random.Random(8)
    counts = [(i, "big" if i % 3 else "small" if i % 9 else None, rng.choice([0, 5, 50, 500])) for i in range(3000)]
    c, w, p = _mix(spark, counts, [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 9), ("null share", None, 1)])
    m = mixing.mix(c, p).collect()
    tokens = {i: n for i, _, n in counts}
    used = {"big": 0, "small": 0}
    times = {}
    for r in m:
        assert r.n_tokens == tokens[r.doc_id] > 0 and 0 <= r.position <= 1
        used[r.source] += r.n_tokens
        times.setdefault((r.source, r.doc_id), []).append(r.copy)
    assert [r.position for r in m] == sorted(r.position for r in m)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in times.values())
    assert max(len(v) for (s, _), v in times.items() if s == "big") <= 1 and max(len(v) for (s, _), v in times.items() if s == "small") <= 3
    share = {r.source: r for r in p.collect()}
    for s in used:
        assert 0 <= used[s] - share[s].demand < 500
    assert abs(used["big"] / sum(used.values()) - 5 / 9) < 0.01
    rep = {r.source: r for r in mixing.shares(c, p, w).collect()}
    assert rep["absent"].reached_share == 0 and rep["small"].used_tokens == used["small"]


def test_weights_move_along_the_schedule(spark):
    counts = [(i, "a" if i % 2 else "b", 10) for i in range(8000)]
    c, _, p = _mix(spark, counts, [("a", 0.5, 1), ("b", 0.5, 2)])
    g = {r.source: r.g for r in p.collect()}
    assert g["a"] == -mixing.SLOPE and g["b"] == mixing.SLOPE
    m = mixing.mix(c, p).toPandas()
    early, late = m[m.position < 0.25], m[m.position > 0.75]
    expected = 0.5 * (1 + mixing.SLOPE * 0.75)
    assert abs((late.source == "b").mean() - expected) < 0.02 and abs((early.source == "b").mean() - (1 - expected)) < 0.02


def test_a_schedule_of_the_callers(spark):
    counts = [(i, "a" if i % 2 else "b", 10) for i in range(8000)]
    c = spark.createDataFrame(counts, "doc_id long, source string, n_tokens long")
    w = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    k = spark.createDataFrame([("a", 0.0, 2.0), ("a", 0.5, 2.0), ("a", 0.500001, 0.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0), ("b", 0.25, 1.0), ("b", 1.0, 1.0), ("x", 0.0, 1.0)], "source string, t double, weight double")
    m = mixing.mix(c, mixing.plan(c, w, schedule=k)).toPandas()
    assert len(m) == 8000 and m.position.between(0, 1).all()
    a, b = m[m.source == "a"].position, m[m.source == "b"].position
    assert a.max() <= 0.5001 and abs((a < 0.25).mean() - 0.5) < 0.01
    # of b's weight 1/8 lies before 0.25 and the rest is level
    assert abs((b < 0.25).mean() - 0.125 / 0.875) < 0.01 and abs((b < 0.625).mean() - 0.5 / 0.875) < 0.01


def test_nothing_to_mix(spark):
    c, w, p = _mix(spark, [], [("a", 1.0, 1)])
    assert mixing.mix(c, p).count() == 0 and mixing.shares(c, p, w).first().reached_share is None


# ------------------------------------------------------------ stuffing

PROSE = "The trustees met before the renewal date and found that two of the policies had been recorded twice. We asked the scheme secretary whether the unpaid premium should be sent to the archive, but there was no reply until the end of the tax year. "
STUFFED = {
    "keywords": "cheap pension transfer best pension transfer uk pension transfer now free pension transfer deals " * 8,
    "sentences": "Get free quote now. We have free quote. Looking for free quote? Free quote here. Best free quote! " * 8,
    "links": " ".join(f"https://deals{i}.example/cheap-{i}.html" for i in range(40)),
    "upper links": " ".join(f"WWW.DEALS{i}.EXAMPLE/CHEAP quote" for i in range(30)),
    "menu": " » ".join(["Home", "Free Quote", "Lump Sum", "Annuity Rates", "Login", "Term Life Cover", "Contact", "Best Pension"] * 6),
    "tags": " ".join(f"#{w}" for w in ("pension", "quote", "best", "free", "annuity", "cover", "deals", "top") for _ in range(6)),
    "wrapped": PROSE + "drawdown calculator free drawdown calculator top drawdown calculator " * 25,
    "function words": "pension transfer of the pension transfer in Dale and the pension transfer to get pension transfer for the pension transfer " * 6,
}
SOUND = {
    "prose": PROSE * 4,
    "upper": (PROSE * 2).upper(),
    "links explained": " ".join(f"https://a.example/{i} explains that the members of the fund keep their annuity unless they choose otherwise, because the rules require it." for i in range(6)),
    "notes": "Tel 2x, no ans. Form 7B outstanding. NOK notified. Bank dtls ok, sort code queried. Closed. ID ok. GP rpt requested.",
    "layout": "Record layout\n" + "\n".join(f"{f}  X  {i}1-{i}9  required" for i, f in enumerate(["STATCD", "EXITDT", "SCHNO", "PREMAMT", "CUSTID", "LOYBONUS"] * 4)),
    "figures": "\n".join(f"{y}  6,777.33  54,271.66" for y in range(1990, 2010)),
    "empty": "", "null": None, "blank": " \n\t ",
}


def test_planted_pages_are_told_apart(spark):
    docs = [(k, t) for k, t in [*STUFFED.items(), *SOUND.items()]]
    df = spark.createDataFrame(docs, "doc_id string, text string").withColumns({"word": F.lit(1), "stretch": F.lit(2)})
    assert {r.doc_id for r in stuffing.stuffed_pages(df).collect()} == set(STUFFED)


#: Ordinary prose, and stuffed pages, in languages the corpus doesn't hold.
UNKNOWN = {
    "pl": "Spółdzielnia zebrała się we wtorek, żeby omówić budżet na przyszły rok. Po długiej dyskusji członkowie postanowili odłożyć remont dachu, ponieważ koszt okazał się wyższy niż przewidywano. Skarbnik zapewnił, że pieniądze wystarczą na bieżące naprawy, a resztę uda się pozyskać z dotacji gminy.",
    "ru": "Вчера вечером собрание жильцов продолжалось почти три часа. Председатель объяснил, почему ремонт крыши пришлось отложить до весны. Некоторые соседи были недовольны, однако большинство согласилось подождать, пока подрядчик не пришлёт новую смету. Следующая встреча назначена на конец месяца.",
    "hi": "कल शाम को गाँव की सभा में नए विद्यालय के बारे में लंबी चर्चा हुई। प्रधान ने बताया कि भवन का काम अगले महीने शुरू होगा। कुछ लोगों ने पूछा कि पैसा कहाँ से आएगा, और उन्हें बताया गया कि सरकार आधा खर्च देगी। बाकी धन चंदे से जुटाया जाएगा।",
    "zh": "昨天晚上，村民们在学校的礼堂里开了一次会，讨论明年春天修路的计划。村长说，工程大约需要三个月，期间车辆必须绕行。有人担心费用太高，不过大多数人认为这条路早就该修了。会议结束以后，大家一起去看了施工图。",
    "es": "La asamblea de vecinos se reunió el martes para hablar del presupuesto del año próximo. Tras una larga discusión decidieron aplazar la reparación del tejado, porque el coste resultó más alto de lo previsto. El tesorero aseguró que el dinero alcanza para lo urgente.",
}
UNKNOWN_STUFFED = {
    "pl": "tania emerytura najlepsza emerytura szybka emerytura online emerytura kalkulator emerytura " * 6,
    "ru": "дешёвая пенсия лучшая пенсия быстрая пенсия онлайн пенсия калькулятор пенсия " * 6,
    "hi": "सस्ती पेंशन सबसे अच्छी पेंशन तेज पेंशन ऑनलाइन पेंशन " * 8,
    "zh": "便宜养老金最好养老金快速养老金在线养老金" * 12,
}


@pytest.mark.parametrize("beside", [False, True])
def test_languages_the_corpus_does_not_know(spark, beside):
    docs = [(f"ok {k}", t, k) for k, t in UNKNOWN.items()] + [(f"bad {k}", t, None) for k, t in UNKNOWN_STUFFED.items()]
    if beside:  # a corpus of another language
        rng = random.Random(11)
        who, did, what, when = (x.split("|") for x in ("The trustees|Our secretary|A member|The actuary|An auditor|Her adviser|His employer|The office", "found|asked about|had lost|signed|sent back|checked|would not accept|paid for", "the old file|two policies|an unpaid premium|the wrong form|a late claim|their records|every certificate|one account", "before the renewal|after a long delay|when the year ended|and told nobody|because it was due|in the spring|at last|for no reason"))
        docs += [(f"en {i}", " ".join(f"{rng.choice(who)} {rng.choice(did)} {rng.choice(what)} {rng.choice(when)}." for _ in range(8)), "en") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id string, text string, lang string")
    got = {r.doc_id for r in stuffing.stuffed_pages(df, lang_col="lang").collect()}
    assert got == {f"bad {k}" for k in UNKNOWN_STUFFED}


def test_a_corpus_shows_its_own_prose_words_and_keywords(spark):
    rng = random.Random(12)
    words = "ka lo mi nu pe ro si ta vu wa xo zy".split()
    prose = lambda: " ".join(" ".join(rng.sample(words, 6) + [f"w{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}x" for _ in range(5)]) + "." for _ in range(6))
    docs = [(f"p{i}", prose(), "qq") for i in range(600)] + [(f"s{i}", " ".join(["drel", rng.choice(["brok", "flim", "gant", "hurp"])] * 25), "qq") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id string, text string, lang string")
    prose_words, keys = stuffing.languages(df.select("text", "lang"))["LATIN:qq"]
    assert set(words) <= prose_words and "drel" in keys
    assert {r.doc_id for r in stuffing.stuffed_pages(df, lang_col="lang").collect()} == {f"s{i}" for i in range(40)}


def test_curves_equal_a_plain_fit():
    import math
    import statistics

    rng = random.Random(13)
    for _ in range(50):
        f = sorted((rng.choice([1, 1, 1, 2, 3, 9]) for _ in range(rng.randint(3, 40))), reverse=True)
        x, y = [math.log(i + 1) for i in range(len(f))], [math.log(n) for n in f]
        slope = statistics.linear_regression(x, y)
        res = math.sqrt(sum((b - slope.intercept - slope.slope * a) ** 2 for a, b in zip(x, y)) / len(x))
        assert stuffing.curve(rng.sample(f, len(f))) == pytest.approx((slope.slope, res, len(f) / sum(f)), abs=1e-9)


@pytest.mark.parametrize("n", [150, 159, 160, 161, 400])
def test_curves_of_many_words_equal_a_plain_fit(n):
    import math
    import statistics

    f = [30, 9, 9, 4, *[2] * (n // 2), *[1] * (n - n // 2 - 4)]
    x, y = [math.log(i + 1) for i in range(n)], [math.log(c) for c in f]
    slope = statistics.linear_regression(x, y)
    res = math.sqrt(sum((b - slope.intercept - slope.slope * a) ** 2 for a, b in zip(x, y)) / n)
    assert stuffing.curve(f) == pytest.approx((slope.slope, res, n / sum(f)), abs=1e-9)


def test_long_and_odd_texts(spark):
    docs = [(1, PROSE * 3000), (2, "x" * 300_000), (3, "a " * 100_000), (4, "。" * 50), (5, "\ue000"), (6, "12 34 " * 30)]
    got = {r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {3}


def test_no_pages(spark):
    assert stuffing.stuffed_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
