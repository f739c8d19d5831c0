import json
import sqlite3

import pytest

from weftline.__main__ import main
from weftline.functions.spread import Spread
from weftline.operators.engine import Config
from weftline.plans import preview, settings
from weftline.plans.q_model import SHOP, shop


def test_specs():
    assert settings.rows(["users=10", "a.b=2.9"]) == {"users": 10, "a.b": 2}
    assert settings.distributions(["a=uniform", "b=zipf", "c=zipf:2", "d=weighted:x=0.9,1=0.1"]) == {"a": Spread(), "b": Spread("zipf", 1.0), "c": Spread("zipf", 2.0), "d": Spread("weighted", weights=(("x", 0.9), (1, 0.1)))}
    assert settings.columns(["a=internet.email", "b=value:30", "c=value:a=b", "d=values:x, true"]) == {"a": "internet.email", "b": {"value": 30}, "c": {"value": "a=b"}, "d": {"values": ["x", True]}}


@pytest.mark.parametrize(("read", "spec"), [(settings.rows, "users"), (settings.rows, "users=-1"), (settings.rows, "users=x"), (settings.distributions, "a=normal"), (settings.distributions, "a=zipf:0"), (settings.distributions, "a=weighted:"), (settings.distributions, "a=weighted:x=0"), (settings.distributions, "a=uniform:1"), (settings.columns, "a="), (settings.columns, "a=values:")])
def test_bad_specs(read, spec):
    with pytest.raises(ValueError):
        read([spec])


def test_file_under_flags(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"rows": {"a": 1, "b": 2}, "seed": 4, "skip": ["x"], "distributions": {"q": {"kind": "zipf", "skew": 2}, "r": "uniform"}, "preserve": ["c"]}))
    got = settings.config(settings.load(str(file)), rows={"b": 3}, skip=("y",), seed=None)
    assert (got.rows, got.seed, got.skip, got.preserve) == ({"a": 1, "b": 3}, 4, ("x", "y"), ("c",))
    assert got.distributions == {"q": Spread("zipf", 2.0), "r": Spread()}
    assert got.default_rows == 10 and got.count(shop().find("users")) == 10


def test_report(spark):
    entries = preview.of_generate(spark, shop(), Config(rows={"users": 1_000_000}, default_rows=2, skip=("order_items",), seed=1))
    text = preview.report(entries)
    assert text.startswith("Plan (dry run") and "main.users" in text and "1000000" in text and "(cyclic)" in text and "(skipped)" in text
    assert [len(e.sample) for e in entries] == [2, 3, 2, 2, 0] and "email: '" in text


def test_offline_run(spark, tmp_path, capsys):
    ddl, out = tmp_path / "s.sql", tmp_path / "o.sql"
    ddl.write_text(SHOP)
    assert main(["--schema-file", str(ddl), "--schema-dialect", "sqlite", "--dialect", "mysql", "-d", "3", "-s", "1", "-o", str(out)]) == 0
    assert out.read_text().startswith("SET FOREIGN_KEY_CHECKS=0;") and "15 rows into 5 tables" in capsys.readouterr().err


def test_sqlite_run_append_and_subset(spark, tmp_path, capsys):
    a, b = str(tmp_path / "a.db"), str(tmp_path / "b.db")
    for f in (a, b):
        with sqlite3.connect(f) as db:
            db.executescript(SHOP)
    assert main([a, "-r", "users=6", "orders=9", "order_items=9", "-d", "3", "-s", "1"]) == 0
    assert main([a, "-r", "orders=4", "--append", "-s", "2"]) == 0
    assert main([a, "--subset", "orders=2", "--to", b, "--preserve", "status"]) == 0
    with sqlite3.connect(a) as x, sqlite3.connect(b) as y:
        assert x.execute("SELECT count(*), max(id) FROM orders").fetchone() == (13, 13) and x.execute("PRAGMA foreign_key_check").fetchall() == []
        assert y.execute("SELECT count(*) FROM orders").fetchone() == (2,) and y.execute("PRAGMA foreign_key_check").fetchall() == []
        real = {r[0] for r in x.execute("SELECT email FROM users")}
        assert not real & {r[0] for r in y.execute("SELECT email FROM users")}
        assert x.execute("SELECT id, status FROM orders ORDER BY id LIMIT 2").fetchall() == y.execute("SELECT id, status FROM orders ORDER BY id").fetchall()
    assert main([a, "--dry-run", "--subset", "orders=1"]) == 0
    assert "Subset plan" in capsys.readouterr().out


@pytest.mark.parametrize("args", [[], ["a.db", "--append"], ["a.db", "--subset", "x=1"], ["--schema-file", "x.sql"], ["--schema-file", "x", "--print", "--append"], ["a.db", "-r", "bad"], ["a.db", "--since", "2024-02-01", "--until", "2024-01-01"], ["a.db", "--print", "-o", "x"]])
def test_modes_that_exclude_each_other(args, monkeypatch):
    monkeypatch.delenv("DATABASE_URL", raising=False)
    with pytest.raises(SystemExit):
        main(args)
