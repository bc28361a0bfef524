"""The load keys go through the typed loader, with every domain table."""

import pytest

from support import SMALL
from mealops.plans.catalog import QUERIES
from mealops.plans.queries_io import DOMAIN_NAME
from mealops.sources import sinks
from mealops.sources.bind import Bound
from mealops.sources.schemas import DOMAIN


@pytest.mark.parametrize("key, n", [("load_tables", 17), ("load_tables_all", 19)])
def test_load_keys_count_loaded_tables(spark, monkeypatch, key, n):
    asked, load = [], sinks.load_tables

    def spy(s, path, names=None):
        out = load(s, path, names)
        asked.extend(out)
        return out
    monkeypatch.setattr(sinks, "load_tables", spy)
    b = Bound(spark, SMALL)
    got = {r["table_name"]: r["n_rows"] for r in QUERIES[key](b).collect()}
    assert len(asked) == n == len(got)
    assert got["plans"] == 3 and got["inventory_logs"] == b.inventory_logs.count()
    assert n < 19 or {DOMAIN_NAME.get(t, t) for t in got} == set(DOMAIN)


def test_written_tables_load_with_equal_values(spark, bound, tmp_path):
    frames = {**bound.frames(), "delivery_addresses": bound.delivery_addresses,
              "loyalty_transactions": bound.loyalty_transactions}
    assert set(frames) == set(DOMAIN)
    sinks.write_tables(frames, str(tmp_path))
    for name, t in sinks.load_tables(spark, str(tmp_path)).items():
        cols = [c for c in frames[name].columns if c in DOMAIN[name].names]
        exp = frames[name].select(*[frames[name][c].cast(DOMAIN[name][c].dataType) for c in cols])
        assert t.schema == DOMAIN[name]
        assert exp.exceptAll(t.select(*cols)).isEmpty() and t.select(*cols).exceptAll(exp).isEmpty(), name
