"""The subgroup errors are of all predicted rows."""

from conftest import SF_SMALL
from regionlens.plans import catalog
from regionlens.sources import fixtures as fx


def test_every_prediction_is_in_a_subgroup(spark):
    rows = catalog.REGISTRY["urban_rural"][0](spark, SF_SMALL).collect()
    assert sum(r.n for r in rows) == fx.predictions(spark, SF_SMALL).count()
