"""Settings of a job, handed through every flow as one value."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import fixed


@dataclass(frozen=True)
class JobSettings:
    """What a user may choose for a run.

    ``prompt_limit`` bounds a prompt in characters; a prompt beyond it is cut
    and its row says so (``truncated``).  ``max_attempts``, ``retry_delay``
    (seconds between attempts) and ``concurrency`` (calls in flight per task)
    are those of the responder that ``responders.from_settings`` makes.
    """

    model: str = fixed.DEFAULT_MODEL
    temperature: float = fixed.DEFAULT_TEMPERATURE
    max_tokens: int = fixed.DEFAULT_MAX_TOKENS
    chunk_size: int = fixed.DEFAULT_CHUNK_SIZE
    prompt_limit: int = fixed.PROMPT_CHAR_LIMIT
    max_attempts: int = fixed.MAX_ATTEMPTS
    retry_delay: float = fixed.RETRY_DELAY
    concurrency: int = 1
