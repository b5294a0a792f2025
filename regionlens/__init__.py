"""regionlens — region-level feature building and evaluation on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function; nothing runs until an action.  Sub-packages:

* ``sources``    scans and sinks (CSV, GeoJSON, raster pixel tables, models),
                 plus the fixture tables derived from the driver's Parquet.
* ``functions``  column expressions (geometry, projection, spectral indices,
                 guarded arithmetic) that stay inside the JVM.
* ``operators``  spatial joins, zonal statistics, cleaning, panel reshaping,
                 profiling, splits, metrics, models, notebook-cell cleaning.
* ``plans``      end-to-end plans (feature matrix) and the query catalogue.
* ``streaming``  the one operator that also runs under ``readStream``.
"""

from regionlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
