"""Batches into a registry, against plain sequential loops."""

import random
import re

import pytest

from loomline.operators import merging

COLUMNS = "ord long, {0} string, profile_id string, person_id string, age_stage string, gender string, race_or_ethnicity string, accent string, occupation string, personality array<string>, aliases array<string>"
REGISTRY = "ord long, role_id string, profile_id string, person_id string, display_name string, age_stage string, gender string, race_or_ethnicity string, accent string, occupation string, personality array<string>, aliases array<string>"


def key(x):
    return "".join(c for c in (x or "").lower() if c.isalnum())


def slug(x):
    return re.sub("[^a-z0-9]+", "_", x.lower()).strip("_")


def profile(r):
    stage = (r["age_stage"] or "unknown").strip().lower().replace(" ", "_") or "unknown"
    person = slug((r["person_id"] or "").strip() or r["name"])
    own = slug(r["profile_id"]) if (r["profile_id"] or "").strip() else person if stage == "unknown" else f"{person}_{stage}"
    return {**r, "stage": stage, "person": person, "id": own, "aliases": [*(r["aliases"] or []), *([f"{r['name']} {stage.replace('_', ' ')}"] if stage != "unknown" else [])]}


def distinct(values):
    seen, out = set(), []
    for v in values:
        if key(v) and key(v) not in seen:
            seen.add(key(v))
            out.append(v)
    return out


def names(*values):
    return {key(v) for v in values} - {""}


def merged(registry, incoming):
    """Role id, stage, gender, personality, aliases and rows of each record, in order."""
    records = [{"id": r["role_id"], "shown": r["display_name"], "stage": (r["age_stage"] or "unknown"), "gender": r["gender"], "personality": r["personality"] or [], "aliases": r["aliases"] or [], "fixed": names(r["role_id"], r["profile_id"], r["person_id"], r["display_name"]), "n": 1} for r in registry]
    for r in map(profile, (r for r in incoming if (r["name"] or "").strip())):
        asks = names(r["name"], r["id"], *r["aliases"], *([r["person"]] if r["stage"] == "unknown" else []))
        for x in records:
            if (x["stage"] == r["stage"] or "unknown" in (x["stage"], r["stage"])) and asks & (x["fixed"] | names(*x["aliases"])):
                x["stage"] = r["stage"] if x["stage"] == "unknown" else x["stage"]
                x["gender"] = r["gender"] if x["gender"] in (None, "", "unknown") and r["gender"] else x["gender"]
                x["personality"] = x["personality"] + (r["personality"] or [])
                x["aliases"] = x["aliases"] + r["aliases"] + ([r["name"]] if key(r["name"]) != key(x["shown"]) else [])
                x["n"] += 1
                break
        else:
            records.append({"id": r["id"], "shown": r["name"], "stage": r["stage"], "gender": r["gender"] or "unknown", "personality": r["personality"] or [], "aliases": r["aliases"], "fixed": names(r["id"], r["person"], r["name"]), "n": 1})
    return [(x["id"], x["stage"], x["gender"], distinct(x["personality"]), distinct(x["aliases"]), x["n"]) for x in records]


def inserted(registry, incoming):
    held = [("narrator", {"narrator"})] + [(r["role_id"], names(r["role_id"], r["profile_id"], *(r["aliases"] or []))) for r in registry]
    out = []
    for r in map(profile, incoming):
        claims = names(r["id"], *r["aliases"])
        by = next((i for i, own in held if own & (claims | names(r["name"]))), None)
        out.append((r["ord"], by is None, by))
        if by is None:
            held.append((r["id"], claims))
    return out


def table(seed, n, words):
    """Registry rows and a batch whose names come from few words, so that long chains and one large component arise."""
    r = random.Random(seed)
    word = lambda: "W" + r.choice("xyz") + str(r.randrange(words))
    some = lambda: r.choice([None, [], [word()], [word(), word().upper() + "."]])
    stage = lambda: r.choice([None, "", "unknown", "Child", "young adult"])
    registry = [{"ord": i, "role_id": f"r{i}", "profile_id": r.choice([None, f"r{i}"]), "person_id": r.choice([None, word()]), "display_name": r.choice([None, word()]), "age_stage": r.choice([None, "child"]), "gender": r.choice([None, "female"]), "race_or_ethnicity": None, "accent": None, "occupation": None, "personality": r.choice([None, ["calm"]]), "aliases": some()} for i in range(n // 8)]
    batch = [{"ord": i, "name": word(), "profile_id": r.choice([None, "", word()]), "person_id": r.choice([None, word()]), "age_stage": stage(), "gender": r.choice([None, "male"]), "race_or_ethnicity": None, "accent": None, "occupation": None, "personality": r.choice([None, ["Calm", "wry"], ["bold"]]), "aliases": some()} for i in range(n)]
    batch += [{**batch[0], "ord": n}, {**batch[0], "ord": n + 1}]
    return registry, batch


@pytest.mark.parametrize("seed,n,words", [(1, 60, 4), (2, 120, 60), (3, 150, 400), (7, 300, 150)])
def test_merged_and_inserted(spark, seed, n, words):
    registry, batch = table(seed, n, words)
    kept, new = spark.createDataFrame(registry, REGISTRY), spark.createDataFrame([*batch, {**batch[0], "ord": n + 2, "name": " "}], COLUMNS.format("name")).repartition(3)
    got = merging.merged(kept, new).orderBy("ord").collect()
    assert [(r["role_id"], r["age_stage"] or "unknown", r["gender"], r["personality"], r["aliases"], r["n_rows"]) for r in got] == merged(registry, batch)
    told = merging.inserted(kept, merging.profiled(new)).orderBy("ord").collect()
    assert [(r["ord"], r["accepted"]) for r in told] == [x[:2] for x in inserted(registry, batch)]
    assert [r["taken_by"] for r in told] == [x[2] for x in inserted(registry, batch)]


def test_a_row_matches_by_an_alias_that_another_left(spark):
    none = {c: None for c in ("profile_id", "person_id", "age_stage", "gender", "race_or_ethnicity", "accent", "occupation", "personality")}
    batch = [{**none, "ord": i, "name": n, "aliases": a} for i, (n, a) in enumerate([("Ana", None), ("Ana", ["the guide"]), ("The Guide", None), ("Bo", None)])]
    got = merging.merged(spark.createDataFrame([], REGISTRY), spark.createDataFrame(batch, COLUMNS.format("name"))).orderBy("ord").collect()
    assert [(r["role_id"], r["n_rows"], r["aliases"]) for r in got] == [("ana", 3, ["the guide"]), ("bo", 1, [])]


def test_empty_sides(spark):
    registry, batch = table(4, 10, 50)
    kept, new = spark.createDataFrame(registry, REGISTRY), spark.createDataFrame(batch, COLUMNS.format("name"))
    nobody, nothing = spark.createDataFrame([], REGISTRY), spark.createDataFrame([], COLUMNS.format("name"))
    assert merging.merged(kept, nothing).count() == len(registry) and merging.merged(nobody, nothing).count() == 0
    assert merging.merged(nobody, new).count() == len(merged([], batch))
    assert merging.inserted(nobody, merging.profiled(nothing)).count() == 0


def test_components(spark):
    pairs = [(i, f"n{i // 2}") for i in range(1, 60)] + [(i, f"m{(i + 1) // 2}") for i in range(1, 60)] + [(100 + i, "hot") for i in range(50)] + [(300, "alone")]
    got = {r["row"]: r["component"] for r in merging.components(spark.createDataFrame(pairs, "row long, name string"), "row", "name").collect()}
    assert got == {**{i: 1 for i in range(1, 60)}, **{100 + i: 100 for i in range(50)}, 300: 300}
