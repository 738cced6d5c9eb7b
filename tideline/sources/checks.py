"""Checks that are counted while the one job that writes a table runs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tideline.sources.files import file_system


class WriteChecks:
    """Expectations on tables along a plan, held against the counts of its write.

    Each expectation is an observation of the rows that pass its place in the
    plan, so nothing is read twice. They are judged when the job has ended:
    ``write`` writes beside the target and moves the result there only if all
    hold, so a failure leaves what was there before, or nothing. Place them
    where no shuffle follows: a map task done again would be counted again.
    """

    def __init__(self):
        self._expected: list[tuple[Observation, dict[str, tuple[int, str]]]] = []
        self.found: dict[str, int] = {}

    def expect(self, df: DataFrame, counts: Mapping[str, tuple[Column, int, str]]) -> DataFrame:
        """Count rows by name; each is (rows that meet it, number expected, what
        is wrong otherwise, with ``{found}`` for the number)."""
        seen = Observation(f"checks-{uuid.uuid4().hex}")
        self._expected.append((seen, {name: (n, said) for name, (_, n, said) in counts.items()}))
        return df.observe(seen, *[F.count_if(c).alias(name) for name, (c, _, _) in counts.items()])

    def judge(self) -> None:
        """Raise for everything that is not as expected; call it after the job."""
        wrong = []
        for seen, expected in self._expected:
            found = seen.get  # nothing where no row can have passed
            for name, (n, said) in expected.items():
                self.found[name] = found.get(name) or 0
                if self.found[name] != n:
                    wrong.append(said.format(found=self.found[name]))
        if wrong:
            raise ValueError("; ".join(wrong))

    def write(self, df: DataFrame, path: str, *, kind: str = "parquet", **options: str) -> str:
        """Write a table in one job, in place of what is at the path, and return the path."""
        spark, target = df.sparkSession, path.rstrip("/")
        staged = f"{target}.unchecked-{uuid.uuid4().hex}"
        where, fs = file_system(spark, staged)
        try:
            df.write.format(kind).options(**options).save(staged)
            self.judge()
            there, _ = file_system(spark, target)
            fs.delete(there, True)
            if not fs.rename(where, there):
                raise OSError(f"{staged} could not be moved to {target}")
        finally:
            fs.delete(where, True)
        return path
