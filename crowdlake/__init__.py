"""crowdlake: crowd, traffic, vessel and weather analytics as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or Column -> Column
for scalar helpers) built from the DataFrame API so that Catalyst can prune,
push down and plan it. Sub-packages:

* ``functions`` – scalar Column expressions (parsing, units, bands).
* ``operators`` – relational operators (reshape, filters, joins, aggregates,
  windows, top-k, set operations, map-ready tables).
* ``sources``   – readers and writers for the feeds' file formats.
* ``ml``        – feature building, splits, boosted trees, forecasting.
* ``streaming`` – the same transforms on Structured Streaming sources.
* ``plans``     – end-to-end jobs and the stand-in tables used by the checks.
"""

from crowdlake.session import get_session, scratch_path  # noqa: F401

__all__ = ["get_session", "scratch_path"]
