"""Typed parameters that the operators take instead of a config file.

Every number, column list and lookup an operator needs is an explicit field
here, so two survey rounds differ only in the ``SurveyParams`` they pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------
# Column lists, code tables, bin edges and labels below are survey recode
# constants. They must equal the published ones for results to agree.

BIRTH_COLUMNS = (
    "caseid", "bidx", "v001", "v005", "v021", "v022", "v024",
    "b19", "b6", "b7", "m3a", "m3b", "m3c", "m3d",
    "m14", "v467b", "v467c", "v467d", "v467f", "bord", "m10",
)
WOMEN_COLUMNS = (
    "caseid", "v001", "v005", "v021", "v022", "v024",
    "v012", "v106", "v511", "v218", "v190", "v025", "v481",
    "v157", "v158", "v159", "v113", "v116", "v701", "v705", "v501", "v212",
)
CLUSTER_COLUMNS = ("DHSCLUST", "ADM1NAME", "ADM1DHS", "URBAN_RURA")
SAMPLING_COLUMNS = ("v001", "v005", "v021", "v022", "v024")

FEATURE_DOMAINS = {
    "maternal_demographic": ("v012", "v106", "v511", "v218", "bord", "v212"),
    "socioeconomic": ("v190", "v025"),
    "health_system_access": ("m14", "v467b", "v467c", "v467d", "v467f", "v481"),
    "media_exposure": ("v157", "v158", "v159"),
    "reproductive": ("m10",),
    "wash": ("v113", "v116"),
    "household_composition": ("v701", "v705", "v501"),
    "geographic": ("v024", "region_stratum"),
    "excluded": ("v131", "v744a", "v744b", "v744c", "v744d", "v744e"),
}

REGION_LABELS_2024 = {
    1: "Tigray", 2: "Afar", 3: "Amhara", 4: "Oromia", 5: "Somali",
    6: "Benishangul-Gumuz", 7: "Central Ethiopia", 8: "Sidama",
    9: "South West Ethiopia", 10: "South Ethiopia", 12: "Gambella",
    13: "Harari", 14: "Addis Ababa", 15: "Dire Dawa",
}
REGION_LABELS_2016 = {
    1: "Tigray", 2: "Afar", 3: "Amhara", 4: "Oromia", 5: "Somali",
    6: "Benishangul-Gumuz", 7: "SNNPR", 12: "Gambella", 13: "Harari",
    14: "Addis Ababa", 15: "Dire Dawa",
}
REGION_STRATA = {
    "Pastoralist/Arid": ("Afar", "Somali"),
    "Agrarian Highlands": (
        "Amhara", "Tigray", "Oromia", "SNNPR", "Central Ethiopia", "Sidama",
        "South Ethiopia", "South West Ethiopia", "Benishangul-Gumuz", "Gambella",
    ),
    "Urban/Peri-urban": ("Addis Ababa", "Dire Dawa", "Harari"),
}
FLAGGED_REGIONS = ("Afar", "Benishangul-Gumuz", "Gambella", "Dire Dawa", "Harari")
CANONICAL_STRATUM_CODES = {
    "Agrarian Highlands": 0,
    "Pastoralist/Arid": 1,
    "Urban/Peri-urban": 2,
}

IMPROVED_WATER_CODES = (10, 11, 12, 13, 20, 21, 30, 31, 41, 51)
IMPROVED_SANITATION_CODES = (10, 11, 12, 13, 14, 15, 20, 21, 22, 23)
UNLABELLED_REGION = "(not in config.region_labels)"
NULL_TOKENS = ("", "nan", "NaN", "NAN", "None", "none", "<NA>", "NA")

VARIABLE_LABELS = {
    "v012": "Respondent's current age",
    "v106": "Highest educational level",
    "v511": "Age at first cohabitation",
    "v218": "Number of living children",
    "bord": "Birth order number",
    "v212": "Age of respondent at 1st birth",
    "v190": "Wealth index combined",
    "v025": "Type of place of residence",
    "m14": "Number of antenatal visits during pregnancy",
    "v467a": "NA - Getting medical help for self: know where to go",
    "v467b": "Getting medical help: permission to go",
    "v467c": "Getting medical help: money needed for treatment",
    "v467d": "Getting medical help: distance to health facility",
    "v467f": "Getting medical help: not wanting to go alone",
    "v481": "Covered by health insurance",
    "v157": "Frequency of reading newspaper/magazine",
    "v158": "Frequency of listening to radio",
    "v159": "Frequency of watching television",
    "m10": "Wanted pregnancy when became pregnant",
    "v113": "Source of drinking water",
    "v116": "Type of toilet facility",
    "v701": "Husband/partner's education level",
    "v705": "Husband/partner's occupation (grouped)",
    "v501": "Current marital status",
    "v024": "Region",
    "b19": "Current age of child in months",
    "region_stratum": (
        "Region stratum (Agrarian Highlands / Pastoralist-Arid / Urban-Peri-urban)"
    ),
    "sba": "Skilled birth attendance (outcome)",
}
# --- End of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Bins:
    """Edges of a binning, with labels for the labelled form."""

    source: str
    edges: tuple[int, ...]
    labels: tuple[str, ...] | None = None
    closed: str = "left"


@dataclass(frozen=True)
class TreeParams:
    """Boosted-tree settings; ``trees`` is the number of boosting rounds."""

    trees: int = 500
    depth: int = 4
    rate: float = 0.03
    row_fraction: float = 0.8
    column_fraction: float = 0.8
    min_leaf: int = 5
    bins: int = 256  # split points tried per feature; survey features have fewer values
    partitions: int | None = None  # of the fixed layout; by the rows, at most the session's shuffle partitions, if not given


@dataclass(frozen=True)
class SurveyParams:
    survey_year: int
    recency_max: int
    region_labels: dict[int, str]
    seed: int = 42
    recency_var: str = "b19"
    woman_key: str = "caseid"
    birth_key: tuple[str, ...] = ("caseid", "bidx")
    cluster: str = "v001"
    fold_cluster: str = "v021"
    outcome: str = "sba"
    attendants: tuple[str, ...] = ("m3a", "m3b", "m3c", "m3d")
    attendant_target: int = 1
    skip_pattern: tuple[str, ...] = ("v511", "v701", "v705")
    skip_sentinel: int = -1
    visits: str = "m14"
    visits_max: int = 20
    weight_var: str = "v005"
    weight_divisor: int = 1_000_000
    folds: int = 5
    holdout_fraction: float = 0.2
    threshold: float = 0.5
    strata: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(REGION_STRATA))
    flagged_regions: tuple[str, ...] = FLAGGED_REGIONS
    small_sample: int = 100
    linkage_tolerance: float = 0.05
    age_bins: Bins = Bins("v012", (15, 20, 25, 30, 35, 40, 45, 50))
    parity_bins: Bins = Bins("v218", (0, 1, 3, 99), ("1", "2-3", "4+"), "right")
    visit_bins: Bins = Bins("m14", (-1, 0, 3, 99), ("0", "1-3", "4+"), "right")
    education: dict[int, str] = field(
        default_factory=lambda: {0: "None", 1: "Primary", 2: "Secondary+", 3: "Secondary+"}
    )
    media: tuple[str, ...] = ("v157", "v158", "v159")
    equity_groups: tuple[str, ...] = ("v190", "v025")
    tree: TreeParams = TreeParams()
    imbalance: str = "class_weight"
    smote_neighbours: int = 5
    smote_continuous: tuple[str, ...] = ("v012", "v218", "bord", "v212", "m14")
    interaction_pairs: tuple[tuple[str, str], ...] = (
        ("region_stratum", "m14"),
        ("region_stratum", "v467d"),
        ("region_stratum", "v190"),
        ("region_stratum", "v157"),
    )
    dependence_vars: tuple[str, ...] = ("m14", "v467d")
    modifiable: tuple[str, ...] = ("m14", "v157", "v158", "v159", "v481")
    semi_modifiable: tuple[str, ...] = ("v467d",)
    counterfactuals: int = 3

    @property
    def features(self) -> list[str]:
        """Model features in declared order, each once; never the excluded set."""
        listed = (
            name
            for domain, names in FEATURE_DOMAINS.items()
            if domain != "excluded"
            for name in names
        )
        return list(dict.fromkeys(listed))

    @property
    def birth_required(self) -> list[str]:
        return [c for c in BIRTH_COLUMNS if c not in (*self.birth_key, "b6", "b7")]

    @property
    def women_required(self) -> list[str]:
        return [c for c in WOMEN_COLUMNS if c not in (self.woman_key, *self.skip_pattern)]

    @property
    def mutable(self) -> list[str]:
        return [*self.modifiable, *self.semi_modifiable]

    @property
    def region_to_stratum(self) -> dict[str, str]:
        return {region: stratum for stratum, names in self.strata.items() for region in names}


def round_2024(**overrides) -> SurveyParams:
    return SurveyParams(
        **{"survey_year": 2024, "recency_max": 59, "region_labels": dict(REGION_LABELS_2024)}
        | overrides
    )


def round_2016(**overrides) -> SurveyParams:
    return SurveyParams(
        **{"survey_year": 2016, "recency_max": 35, "region_labels": dict(REGION_LABELS_2016)}
        | overrides
    )
