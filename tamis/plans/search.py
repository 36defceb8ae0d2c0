"""The search façade: a batch of questions to kept and rejected passages with gate statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tamis.operators import dense, fusion, gate, lexical
from tamis.operators.fusion import SearchParams
from tamis.session import cut


@dataclass
class Found:
    candidates: DataFrame
    selection: DataFrame
    gate: DataFrame


def search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, query: str = "ligne", text: str = "requete", vector: str = "vecteur", params: SearchParams = SearchParams()) -> Found:
    """`questions`: query, text and vector columns; `chunks`: i, doc, off, structure, texte; `vectors`: i, embedding."""
    a = lexical.search(chunks, questions, "i", "texte", query, text, params.k_pool)
    b = dense.search(vectors, questions, "i", "embedding", query, vector, params.k_pool)
    both = cut(fusion.fuse(a, b, chunks, query, params=params))
    kept = cut(fusion.select(both, query, params))
    stats = gate.score_statistics(both, kept, query).join(gate.coverage(questions, chunks, fusion.kept_rows(kept, query), query, text), query, "full_outer")
    return Found(both, kept, stats)
