import json
import random

import pytest
from pyspark.sql import functions as F

from leadloom.config import LeadConfig
from leadloom.functions import contacts
from leadloom.operators import diagnose, lookup
from leadloom.shared import shared_path


def test_settings_from_a_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"geo_suspect_tlds": ["ru"], "max_contact_paths": {"static": 9}}))
    c = LeadConfig.load(str(tmp_path / "c.json"))
    assert c.geo_suspect_tlds == ["ru"] and c.max_contact_paths == {"static": 9, "rendered": 2} and c.engines == LeadConfig().engines
    (tmp_path / "d.json").write_text(json.dumps({"geo_tlds": ["ru"]}))
    with pytest.raises(ValueError, match="geo_tlds"):
        LeadConfig.load(str(tmp_path / "d.json"))


def test_unknown_engines_come_last(values):
    assert values(lambda e: lookup.engine_rank(e, ["a", "b"]), "b", "a", "other", None) == [2, 1, 3, 3]


def test_runs_across_buckets(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(e, a // 10, a, rng.choice([200, 429, 429, 500])) for e in ("x", "y", "z") for a in range(400)]
    want, ban = [], {}
    for e in ("x", "y", "z"):
        own = [r for r in rows if r[0] == e]
        k = 0
        while k < len(own):
            n = 0
            while k + n < len(own) and own[k + n][3] == 429:
                n += 1
            if n >= 3:
                want.append((e, own[k][2], n))
                ban.setdefault(e, own[k + 2][1])
            k += max(n, 1)
    monkeypatch.setattr(diagnose, "BUCKET_ATTEMPTS", 7)
    log = spark.createDataFrame(rows, "engine string, query_idx long, attempt long, http_status int")
    assert sorted(tuple(r) for r in diagnose.ban_runs(log).collect()) == sorted(want)
    assert sorted(tuple(r) for r in diagnose.until_ban(log).collect()) == sorted(r for r in rows if r[1] <= ban[r[0]])
    assert diagnose.ban_runs(log.limit(0)).count() == 0 and diagnose.until_ban(log.filter("http_status <> 429")).count() == sum(r[3] != 429 for r in rows)


def test_many_phones_keep_their_order(values):
    rng = random.Random(2)
    raw = [f"020 7946 {rng.randint(1000, 1999)}"[: rng.choice([13, 13, 12])] for _ in range(3000)]
    first = list({"".join(c for c in r if c.isdigit()): r.strip() for r in raw[::-1]}.items())
    place = {}
    for r in raw:
        place.setdefault("".join(c for c in r if c.isdigit()), r.strip())
    assert len(first) == len(place)
    assert values(contacts.valid_phones, raw, [], None, kind="array<string>") == [[v for k, v in place.items() if "000" not in k and 7 <= len(k) <= 15], [], None]


def test_shared_folder_is_needed_off_one_machine(spark):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_path(Session, "x")
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_running_sums(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, i int")
    got = {(r.g, r.i): r.s for r in lookup.running(df, ["g"], [F.col("i")], F.floor(F.col("i") / 8), F.lit(1), "s").collect()}
    assert got == {(i % 3, i): i // 3 + 1 for i in range(100)}
