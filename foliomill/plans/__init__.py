"""Named queries over the driver tables; importing registers them."""

from foliomill.plans import answers, changes, indexes, samples, scalars, search, statistics, streams, syncs, texts, vector, windows  # noqa: F401
