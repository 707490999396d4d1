"""Objects that a Python worker keeps from task to task."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from typing import Any


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The object made for this key by the first task of this worker process. A lost worker makes it again. Task
    functions travel by value, so their modules' globals start anew with each task; this lives beside them."""
    held = sys.__dict__.setdefault("_kept_by_worker", {})
    if key not in held:
        held[key] = make()
    return held[key]


def load_tokenizer(path: str) -> Any:
    """A tokenizer that treats special strings in texts as text, without a thread pool of its own (Spark runs a worker
    for each core)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t
