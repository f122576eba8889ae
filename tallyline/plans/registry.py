"""Named projectors with the feature layers and adjustments they combine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tallyline.plans import features as ft
from tallyline.plans.adjusted import AdjustedProjector, AdpProjector, NaiveLastSeason, clock_design, offseason_design, terms_design
from tallyline.plans.projector import BaselineProjector, register_projector
from tallyline.plans.rates import BaselineConfig

EVIDENCE_MINUTES = (60.0, 120.0, 240.0, 480.0)


def baseline(scoring: Mapping[str, float], config: BaselineConfig | None = None) -> BaselineProjector:
    return BaselineProjector(scoring, config)


def with_availability(name: str, *layers):
    """Factory of a baseline whose availability model sees extra layers."""
    def make(scoring: Mapping[str, float], config: BaselineConfig | None = None, **tables: DataFrame) -> BaselineProjector:
        return BaselineProjector(scoring, config, name=name, availability_features=[layer(**{k: v for k, v in tables.items()}) for layer in layers])
    return make


def with_minutes(name: str, layer):
    """Factory of a baseline whose minutes are shifted by a clipped regression on a layer."""
    def make(scoring: Mapping[str, float], config: BaselineConfig | None = None, **tables: DataFrame) -> BaselineProjector:
        return BaselineProjector(scoring, config, name=name, minutes_features=[layer(**tables)])
    return make


def offseason(scoring: Mapping[str, float], logs: DataFrame, team_games: DataFrame, config: BaselineConfig | None = None, *, components: bool = False) -> AdjustedProjector:
    designs = [offseason_design(logs, team_games, scoring, evidence_minutes=k, components=components) for k in EVIDENCE_MINUTES]
    return AdjustedProjector(baseline(scoring, config), scoring, designs, name="baseline_offseason", center=True, use_intercept=True, min_gain=0.002, ridges=(3.0, 30.0, 300.0, 3000.0), limits=(0.6, 1.6))


register_projector("naive_last_season", NaiveLastSeason)
register_projector("adp", lambda scoring=None, adp=None: AdpProjector(adp))
register_projector("baseline", baseline)
register_projector("baseline_hurdle", lambda scoring, **kw: BaselineProjector(scoring, BaselineConfig(appearance_hurdle=True, season_intervals=True), name="baseline_hurdle", **kw))
register_projector("baseline_injury", with_availability("baseline_injury", lambda: ft.absence_features()))
register_projector("baseline_return", with_availability("baseline_return", lambda: ft.absence_features(), lambda: ft.return_features()))
register_projector("baseline_injury_labels", lambda scoring, reports, config=None: BaselineProjector(scoring, config, name="baseline_injury_labels", availability_features=[ft.label_features(reports)]))
register_projector("baseline_roster", with_minutes("baseline_roster", lambda: ft.roster_features()))
register_projector("baseline_transactions", with_minutes("baseline_transactions", lambda transactions: ft.transaction_features(transactions)))
register_projector("baseline_depth", with_minutes("baseline_depth", lambda transactions, playoffs: ft.depth_features(transactions, playoffs)))
register_projector("baseline_coach", with_minutes("baseline_coach", lambda leaders: ft.coach_features(leaders)))
register_projector("baseline_adp", lambda scoring, adp, config=None: BaselineProjector(scoring, config, name="baseline_adp", availability_features=[ft.adp_features(adp)], minutes_features=[ft.adp_features(adp)]))
register_projector("baseline_offseason", offseason)
register_projector("baseline_contract", lambda scoring, config=None: AdjustedProjector(baseline(scoring, config), scoring, clock_design(), name="baseline_contract"))
register_projector("baseline_contract_terms", lambda scoring, contracts, config=None: AdjustedProjector(baseline(scoring, config), scoring, terms_design(contracts), name="baseline_contract_terms"))
