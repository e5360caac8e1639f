"""The catalog of queries."""

from trackweave.plans import catalog, depth, flight, more, routes, streets, tracks  # noqa: F401  all add to the catalog
