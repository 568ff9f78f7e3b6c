"""Building, searching and evaluating corpora of passages on Spark.

    from passagework import named, top_k
    model = named("grams-256")
    vectors = model.encode_passages(passages, F.col("text"))

Names are imported when they are asked for, so that tasks which need none of them don't.
"""

from importlib import import_module

_PLACES = {
    "Model": ("models", "Model"), "named": ("models", "named"), "TemplateMode": ("encode", "TemplateMode"), "top_k": ("vectors", "top_k"),
    "build_index": ("index", "build"), "open_index": ("index", "open_index"), "search_index": ("index", "search"),
}
__all__ = sorted(_PLACES)  # noqa: PLE0605
__version__ = "0.3.0"


def __getattr__(name: str) -> object:
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, held = _PLACES[name]
    return getattr(import_module(f"passagework.operators.{module}"), held)
