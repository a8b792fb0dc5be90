"""The queries of this subpackage and their SQL."""

from quietsky.llm import centroids, flac, jaccard, language, merkle, mixing, pseudo, quality, ring, secrets, sentence, transducer, voronoi

_MODULES = (ring, sentence, mixing, secrets, language, flac, quality, pseudo, jaccard, voronoi, merkle, centroids, transducer)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
