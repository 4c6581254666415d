"""The library's queries, by family; importing this package registers them."""

from driftloom.plans import completions, images, maps, metrics, recognition, relational, resampling, shift, statistics, streams, validation, vectors  # noqa: F401
