"""A whole audit of named runs, as named lazy tables.  A check whose run is absent makes no table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.operators import confidence, diff, fidelity, leakage, stats

#: Differences below this similarity are of substance.
SUBSTANTIVE = 0.8


@dataclass
class Audit:
    """``primary`` is audited; the other runs, each optional, are what it is compared with.

    Every table is a plan; nothing runs before a table is read.  Records that several tables
    share can be persisted by the caller.
    """

    primary: DataFrame
    repetition: DataFrame | None = None
    other_input: DataFrame | None = None
    other_temperature: DataFrame | None = None
    prompt_runs: tuple[DataFrame, DataFrame] | None = None
    rule: confidence.Rule = field(default_factory=confidence.Rule)
    gold: DataFrame | None = None

    @cached_property
    def assigned(self) -> DataFrame:
        return confidence.assign(confidence.evidence(self.primary, self.repetition, self.other_input, rule=self.rule), self.rule)

    def _rows(self, run: DataFrame) -> DataFrame:
        return stats.audited(run, gold=self.gold)

    def _side_by_side(self, a: DataFrame, b: DataFrame) -> DataFrame:
        both = self._rows(a.withColumn("side", F.lit("a"))).unionByName(self._rows(b.withColumn("side", F.lit("b"))))
        return stats.side_by_side(stats.run_stats(both, "side"), "side", "a", "b").orderBy("ord").drop("ord")

    def tables(self) -> dict[str, DataFrame]:
        checked = fidelity.check_fidelity(self.primary, self.rule.fidelity)
        out = {"fidelity": checked, "fidelity_summary": fidelity.fidelity_summary(checked), "leaks": leakage.leaks(self.primary, threshold=self.rule.leakage_threshold)}
        if self.repetition is not None:
            diffs = diff.field_diffs(self.primary, self.repetition)
            out |= {"stability_fields": diff.field_summary(diffs), "stability": diff.diff_summary(diffs), "stability_warnings": diff.config_warnings(self.primary, self.repetition)}
        if self.other_input is not None:
            diffs = diff.field_diffs(self.primary, self.other_input)
            out |= {"input_fields": diff.field_summary(diffs), "input": diff.diff_summary(diffs), "input_disagreements": diff.disagreements(diffs, SUBSTANTIVE), "input_metrics": self._side_by_side(self.primary, self.other_input)}
        if self.other_temperature is not None:
            same = diff.restrict_to(self.primary, self.other_temperature)
            out |= {"temperature": stats.compare_temperatures(self.primary, self.other_temperature), "temperature_fields": diff.field_summary(diff.field_diffs(same, self.other_temperature)), "temperature_metrics": self._side_by_side(same, self.other_temperature)}
        if self.prompt_runs is not None:
            out |= {"prompts": self._side_by_side(*self.prompt_runs), "prompt_fields": diff.field_summary(diff.field_diffs(*self.prompt_runs))}
        return out | {"confidence": confidence.distribution(self.assigned), "cards": confidence.final_table(self.assigned), "not_defensible": confidence.not_defensible(self.assigned).select("doc", "confidence", "reasons")}


def audit_runs(load: Callable[[str], DataFrame], runs: Mapping[str, str], rule: confidence.Rule | None = None, gold: DataFrame | None = None) -> Audit:
    """An audit from run ids by role: primary, repetition, other_input, other_temperature, other_prompt."""
    if unknown := runs.keys() - {"primary", "repetition", "other_input", "other_temperature", "other_prompt"}:
        raise ValueError(f"unknown roles: {sorted(unknown)}")
    got = {role: load(run) for role, run in runs.items() if run}
    prompt = got.pop("other_prompt", None)
    return Audit(**got, prompt_runs=None if prompt is None else (got["primary"], prompt), rule=rule or confidence.Rule(), gold=gold)
