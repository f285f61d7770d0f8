"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from inkveil.llm import language, licenses, mixing, mpeg_audio, near_dup, packing, quality, repeats, token_counts, vectors

_MODULES = (language, packing, token_counts, quality, near_dup, repeats, vectors, mpeg_audio, licenses, mixing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
