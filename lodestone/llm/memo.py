"""A bounded memory of what words are worth."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


class Memo:
    """Values by word in two generations: when the young one is full, the old one goes.

    Words in use move back into the young generation, so common words stay.
    """

    def __init__(self, bound: int):
        self.half = bound // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def peek(self, word: str) -> bytes | None:
        return self.young.get(word) or self.old.get(word)

    def learn(self, words: set[str], values: Callable[[list[str]], Iterable[bytes]]) -> Callable[[str], bytes]:
        """Lookup that knows all of ``words``; ``values`` gives those of the unknown."""
        missing = words.difference(self.young)
        if len(self.young) + len(missing) > self.half:
            self.old, self.young = self.young, {}
            missing = words
        new = []
        for word in missing:
            if (value := self.old.get(word)) is None:
                new.append(word)
            else:
                self.young[word] = value
        self.young.update(zip(new, values(new)))
        return self.young.__getitem__


def _bytes(text: str, unit: str = "m") -> int:
    number, own = re.fullmatch(r"(\d+)([bkmgt]?)b?", text.strip().lower()).groups()
    return int(number) * 1024 ** "bkmgt".index(own or unit)


def words_held(spark: SparkSession, each: int, wanted: int) -> int:
    """How many words of ``each`` bytes a Python worker may keep: those of ``wanted`` bytes, or fewer where its container is smaller.

    Workers live outside the executor's heap. What the session gives them, ``spark.executor.pyspark.memory``
    or else ``spark.executor.memoryOverhead``, is dealt to the cores, a worker each, and words take half of
    that at most. On YARN and Kubernetes, where neither is set, Spark's own overhead counts: a tenth of the
    heap (``spark.executor.memoryOverheadFactor``), 384 MB at least. Elsewhere no container bounds a worker.
    """
    conf, master = spark.sparkContext.getConf(), spark.sparkContext.master
    given = conf.get("spark.executor.pyspark.memory", conf.get("spark.executor.memoryOverhead", ""))
    left = _bytes(given) if given else 0
    if not left and master.startswith(("yarn", "k8s")):
        left = max(384 << 20, int(_bytes(conf.get("spark.executor.memory", "1g")) * float(conf.get("spark.executor.memoryOverheadFactor", "0.1"))))
    if left:
        cores = int(conf.get("spark.executor.cores", "1" if master.startswith(("yarn", "k8s")) else str(spark.sparkContext.defaultParallelism)))
        wanted = min(wanted, left // (2 * max(1, cores)))
    return max(10_000, wanted // each)


_held = None


def claim(memory) -> None:
    """Let this worker process hold ``memory`` (with a ``clear``, or None) alone: what another operator held goes."""
    global _held
    if _held is not None and _held is not memory:
        _held.clear()
    _held = memory
