"""Settings of the retrieval jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CodePattern:
    """A rule for an identifier: the key is ``prefix-ID`` in upper case; ``regex`` has one capturing group,
    ``(?P<id>...)``. ``first`` lists the characters that a match can begin with; without it matches are
    the same and take longer to find."""

    name: str
    prefix: str
    regex: str
    first: str = ""


# The default identifier rules, lead-in words, separators and id grammars.
DEFAULT_CODE_PATTERNS = (
    CodePattern("alarm", "AL", r"(?:ALARM|ALM|AL)[\s\-:_]*(?P<id>\d{1,4}[A-Z]?)", "Aa"),
    CodePattern("stop", "SC", r"(?:STOP[\s\-]?CODE|STOP|SC)[\s\-:_]*(?P<id>\d{1,4})", "Ssſ"),
    CodePattern("fault", "F", r"(?:FAULT|FLT|F)[\s\-:_]*(?P<id>\d{2,4})", "Ff"),
    CodePattern("error", "E", r"(?:ERROR|ERR|E)[\s\-:_]*(?P<id>\d{2,4})", "Ee"),
    CodePattern("dtc", "DTC", r"DTC[\s\-:_]*(?P<id>[A-Z]?\d{2,5})", "Dd"),
    CodePattern("warning", "W", r"(?:WARNING|WARN|W)[\s\-:_]*(?P<id>\d{2,4})", "Ww"),
    CodePattern("part", "PN", r"(?:PART\s+(?:NO\.?|NUMBER)|PART|P/?N)[\s\-:#]*(?P<id>[A-Z0-9]{2,}(?:-[A-Z0-9]+)+)", "Pp"),
)


# The default budgets, number of hits, cutoff and base score.
@dataclass(frozen=True)
class ChunkingConfig:
    max_chars: int = 1200
    step_max_chars: int = 2400
    keep_tables_intact: bool = True
    keep_steps_intact: bool = True


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 6
    min_score: float = 0.45
    code_base_score: float = 1.0


# Fixed value: the sentence that says that nothing was found; also what a model is told to answer then.
NOT_FOUND = "I could not find an answer to that in the provided documents."
