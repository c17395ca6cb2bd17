"""A text's cipher is judged by the whole text, not by how it begins."""

from __future__ import annotations

from collections import Counter

from caseloom.llm import encodings

SPANISH = "según el señor de la oficina la dirección número uno fue añadida después por la compañía también está aquí "


def test_utf8_is_seen_behind_a_beginning_of_unknown_signs():
    pairs: Counter[str] = Counter()
    encodings.pairs_of(SPANISH * 2000, pairs)
    model = encodings.Model(dict(pairs))
    model.prepare()
    meant = "ŋ " * 20 + SPANISH * 20  # no text and no page has the sign of the beginning
    garbled = meant.encode("utf-8").decode("latin-1")
    assert encodings.restore(garbled, model) == (meant, "utf-8>latin-1")
    # of signs that are known nowhere nothing can be said
    alone = ("ŋ " * 20).encode("utf-8").decode("latin-1")
    assert encodings.restore(alone, model) == (alone, "")
