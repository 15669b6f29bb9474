"""Defaults of the operators."""

RETRIEVE_LIMIT = 5
SEARCH_LIMIT = 10
PAGE_LIMIT = 100
TOP_K = 5
PATH_CAP = 100
PATH_DEPTH = 10
REST_PATH_DEPTH = 5
SUBGRAPH_DEPTH = 2
RRF_K = 60
HYBRID_WEIGHTS = (0.6, 0.4)
MEDIA_WEIGHTS = (0.5, 0.5)
SHORT_TEXT = 10
EMBED_BATCH = 10
WORKER_BATCH = 100
ENTITY_MATCH = 0.75
ENTITY_TOP = 3
DIMENSIONS = {"small": 1536, "large": 3072, "store": 1024, "simple": 768}
#: Sides of joins up to this many rows may be broadcast; the row count is taken first.
BROADCAST_ROWS = 100_000
APPEARS_IN, TYPE, DESCRIPTION, IS_DOCUMENT, RELATED_TO = "APPEARS_IN", "TYPE", "DESCRIPTION", "is_document", "RELATED_TO"
#: Triples that the context of an answer takes, the first in their order.
CONTEXT_TRIPLES = 10_000
PROPERTY_PREDICATES = (APPEARS_IN, TYPE, DESCRIPTION)
EMPTY_ANSWER = "No relevant information found."
