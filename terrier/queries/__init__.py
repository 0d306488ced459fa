"""The registered queries."""

from terrier.queries import deeds, prices, shapes
from terrier.queries.tables import Query

ALL: dict[str, Query] = {**prices.QUERIES, **deeds.QUERIES,
                        **shapes.QUERIES}
