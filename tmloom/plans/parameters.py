"""Job parameters.  None of them is a secret: model clients belong to the caller."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from tmloom.functions import fixed_values as fv


@dataclass(frozen=True)
class LineParameters:
    batch_size: int = fv.LINE_BATCH_SIZE
    max_attempts: int = fv.LINE_MAX_ATTEMPTS
    postings_per_token: int = fv.POSTINGS_PER_TOKEN
    min_similarity: float = fv.MIN_SIMILARITY
    duplicate_similarity: float = fv.DUPLICATE_SIMILARITY
    max_hints: int = fv.MAX_HINTS_PER_BATCH
    instruction: str = fv.LINE_INSTRUCTION
    source_lang: str = fv.SOURCE_LANG
    target_lang: str = fv.TARGET_LANG
    failure_mark: str = fv.FAILURE_MARK
    retry_pause: float = fv.LINE_RETRY_PAUSE_SECONDS
    dedupe: bool = False  # send each distinct line once


@dataclass(frozen=True)
class DocumentParameters:
    max_chars: int = fv.CHUNK_MAX_CHARS
    max_attempts: int = fv.BLOCK_MAX_ATTEMPTS
    hints_per_block: int = fv.HINTS_PER_BLOCK
    retry_base_delay: float = fv.RETRY_BASE_DELAY
    rate_limit_cap: float = fv.RATE_LIMIT_DELAY_CAP
    error_cap: float = fv.ERROR_DELAY_CAP
    limit_blocks: int = 0
    system: str = fv.BLOCK_SYSTEM

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)
