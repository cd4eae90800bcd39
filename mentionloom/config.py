"""Configuration of a linking run."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

RANK_SCHEMES = ("PRIOR_SEM", "LOCAL_SEM", "SEMANTIC", "LINEAR", "MULTIPLY", "NOR")


@dataclass(frozen=True)
class LinkConfig:
    """All parameters of candidate selection, graph expansion, random walks and scoring.

    strict keeps documented oddities of the original behaviour (see README);
    the default gives the corrected one.
    """

    use_unambiguous: bool = True
    use_iterative: bool = True
    mention_preference: str = "UNIFORM"  # UNIFORM, RANDOM, TFIDF
    entity_preference: str = "UNIFORM"  # UNIFORM, RANDOM, PRIOR_PROB, CTX_SIM
    context: str = "document"  # document, sentence
    weighted: bool = True
    directed: bool = False
    expand_level: int = 1
    min_in_degree_directed: int = 200
    min_in_degree_undirected: int = 600
    prior_weight: float = 0.08
    local_weight: float = 0.1
    rank_scheme: str = "MULTIPLY"
    top_by_context: int = 3
    top_by_prior: int = 3
    min_prior: float = 2e-5
    selection: str = "union"  # union (best by context or prior), source (thresholds by source), normalized (union; unknown names again by their normalised form)
    link_threshold: float = 0.005
    other_threshold: float = 0.001
    top_by_source: int = 20
    cooccurrence_window: int = 1000
    alpha: float = 0.85
    steps: int = 3
    walk_threshold: float = 1e-5
    supervised: bool = False
    nil_prediction: bool = False
    #: Similarity of a candidate whose walk equals the document's, 1 over this divergence.
    least_divergence: float = 1e-9
    order: str = "desc"  # most ambiguous mention first
    strict: bool = False

    def __post_init__(self):
        scheme = {"MULTIPLE": "MULTIPLY"}.get(self.rank_scheme, self.rank_scheme)
        if self.strict:
            scheme = {"MULTIPLY": "LINEAR" if self.rank_scheme == "MULTIPLY" else "MULTIPLY", "VOTE": "SEMANTIC"}.get(scheme, scheme)
        if scheme not in RANK_SCHEMES:
            raise ValueError(f"rank scheme {self.rank_scheme}: one of {', '.join(RANK_SCHEMES)} is needed")
        object.__setattr__(self, "rank_scheme", scheme)
        for name, allowed in (("selection", ("union", "source", "normalized")), ("context", ("document", "sentence")), ("mention_preference", ("UNIFORM", "RANDOM", "TFIDF"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} {getattr(self, name)}: one of {', '.join(allowed)} is needed")

    @property
    def min_in_degree(self) -> int:
        return self.min_in_degree_directed if self.directed else self.min_in_degree_undirected

    @classmethod
    def from_properties(cls, path: str | Path, **more) -> LinkConfig:
        """Read key = value lines; unknown keys are ignored."""
        names = {
            "weighted": "weighted",
            "useUnambigEntity": "use_unambiguous",
            "useIterative": "use_iterative",
            "mentionPrefStrategy": "mention_preference",
            "entityPrefStrategy": "entity_preference",
            "contextOption": "context",
            "priorWeight": "prior_weight",
            "localWeight": "local_weight",
            "rankScheme": "rank_scheme",
            "supervised": "supervised",
            "NILPrediction": "nil_prediction",
        }
        kinds = {f.name: f.type for f in fields(cls)}
        found = {}
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, equal, value = line.strip().partition("=")
            name = names.get(key.strip())
            if not equal or key.lstrip().startswith(("#", "!")) or not name:
                continue
            value = value.strip()
            found[name] = value == "1" or value.lower() == "true" if kinds[name] == "bool" else float(value) if kinds[name] == "float" else value
        return cls(**found | more)
