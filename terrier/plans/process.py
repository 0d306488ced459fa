"""From deed lines to the processed table: one row per sale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier import schema as S
from terrier.functions import columns as C
from terrier.operators import groups
from terrier.operators.lookups import add_lookup, missing_totals, region_mapping
from terrier.operators.outliers import remove_outliers
from terrier.operators.skew import LIGHT_ROWS, split_heavy
from terrier.operators.spatial import point_in_zone, project_points
from terrier.operators.time_index import adjust_prices
from terrier.session import staged

#: What the reduction reads; lots and former codes are never parsed.
LINE_COLUMNS = tuple(dict.fromkeys((
    *S.DISPOSITION, *(c for c in (*S.FIRSTS, *S.LISTS, *S.SUMS)
                      if c not in ("has_dependency", "surface_batie_totale", "prix_de_vente")),
    "seq")))


def clean_lines(lines: DataFrame, mode: str) -> DataFrame:
    """Undo duplication by land use, flag outbuildings, keep homes, share out the price."""
    order = ["seq"]

    def settled(rows: DataFrame) -> DataFrame:
        # the heavy forms read their input twice, so their steps must not pile up
        return staged(rows) if mode == "heavy" else rows

    home = C.relevant(
        "nature_mutation", S.SALE_NATURES, "type_local", (S.HOUSE, S.FLAT), "valeur_fonciere",
        S.MIN_VALUE, "surface_reelle_bati", ("latitude", "longitude"))
    outbuilding = F.col("type_local") == S.OUTBUILDING
    rows = settled(groups.keep_first_category(lines, S.USE_GROUP, "nature_culture", order, mode)
                   .where(home | outbuilding))  # no other line sets a flag or stays
    rows = settled(groups.flag_group(
        rows, S.OUTBUILDING_GROUP, outbuilding, "has_dependency", order, mode)).where(home)
    rows = settled(groups.group_totals(
        rows, S.DISPOSITION, {"surface_batie_totale": "surface_reelle_bati"},
        {"valeur_moyenne": "valeur_fonciere"}, order, mode))
    return groups.allocate(rows, "valeur_moyenne", "surface_batie_totale", "surface_reelle_bati",
                           "prix_de_vente")


def deed_items(lines: DataFrame, light_rows: int = LIGHT_ROWS) -> DataFrame:
    """The kept lines of every disposition, numbered by ``position``, with its sums.

    All groups of this step nest in the disposition, so ordinary ones need a
    single shuffle of the lines: every window reuses it. Huge dispositions are split
    off first and go through salted joins and running numbers over ranges; their rows
    have the same form. Lines that are no sales go before that: the groups in which land
    use and outbuildings are told are of one nature each, so no sale depends on them.
    """
    lines = C.fill_unknown(lines.where(F.col("nature_mutation").isin(*S.SALE_NATURES)), S.LAND_USE)
    light, heavy = split_heavy(lines, S.DISPOSITION, light_rows, many=True)

    def chain(rows: DataFrame, mode: str) -> DataFrame:
        return groups.number_items(clean_lines(rows, mode), S.DISPOSITION, ["seq"],
                                   {f"total_{c}": c for c in S.SUMS}, mode=mode)

    out = chain(light.repartition(*S.DISPOSITION), "light")
    return out if heavy is None else out.unionByName(chain(heavy, "heavy"))


def sales_of(items: DataFrame) -> DataFrame:
    """One row per disposition: its first values, the first parcel, and its sums."""
    return items.where("position = 0").select(
        *S.DISPOSITION, *S.FIRSTS, F.col("id_parcelle").alias("id_parcelle_unique"),
        *[F.col(f"total_{c}").alias(c) for c in S.SUMS])


def lists_of(items: DataFrame) -> DataFrame:
    """The listed values of every disposition, one row per place in its lists."""
    return items.select(*S.DISPOSITION, "position", *S.LISTS)


def reduce_deeds(lines: DataFrame, light_rows: int = LIGHT_ROWS) -> DataFrame:
    """One row per disposition."""
    return sales_of(deed_items(lines, light_rows))


def derive(reduced: DataFrame, departments: DataFrame, regions: DataFrame) -> DataFrame:
    """Price per square metre, key, first parcel and region."""
    rows = reduced.withColumns({
        "prix_m2": C.unit_price("valeur_fonciere", "surface_batie_totale"),
        "cle_principale": C.composite_key(*S.DISPOSITION)})
    return add_lookup(rows, region_mapping(departments, regions, "code_region"),
                      "code_departement", ["cle_principale"])


def assign_zones(sales: DataFrame, zones: DataFrame, size: float = 1000.0) -> DataFrame:
    """Add ``code_iris`` and ``nom_iris`` of the zone (in Lambert-93) around each sale."""
    placed = project_points(sales, x="__x", y="__y")
    ordered = zones.select("code_iris", "nom_iris", "geom")
    return point_in_zone(placed, ordered, "__x", "__y", "geom", "code_iris",
                         ["code_iris", "nom_iris"], ["cle_principale"], size).drop("__x", "__y")


def read_items(lines: DataFrame, light_rows: int = LIGHT_ROWS) -> DataFrame:
    """The numbered lines of all dispositions, in the shared folder.

    Later passes read them several times, a few columns at a time. The lines themselves
    are read twice, once for two keys and the nature alone, which takes less than
    writing them down would.
    """
    return staged(deed_items(lines.select(*LINE_COLUMNS), light_rows))


def finish(sales: DataFrame, departments: DataFrame, regions: DataFrame, zones: DataFrame) -> DataFrame:
    """The processed table, of one row per disposition: no outliers, adjusted prices, zones."""
    groups.require_unique(sales, F.struct(*S.DISPOSITION))
    clean = staged(remove_outliers(
        derive(sales, departments, regions), S.BOUNDS, "code_commune", ["cle_principale"],
        S.FENCE_MIN_ROWS, S.FENCE_WIDTH))
    dated = clean.withColumn("annee_mutation", F.year("date_mutation"))
    adjusted = adjust_prices(dated, ["code_departement", "type_local"], "annee_mutation",
                             "prix_m2", S.REFERENCE_YEAR, "prix_m2_ajuste", ["cle_principale"])
    return assign_zones(adjusted, zones)


def process(lines: DataFrame, departments: DataFrame, regions: DataFrame, zones: DataFrame,
            light_rows: int = LIGHT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The processed table, one row per sale, and its lists, one row per place in them."""
    items = read_items(lines, light_rows)
    sales = staged(finish(sales_of(items), departments, regions, zones))
    kept = sales.select(*S.DISPOSITION)
    return sales, lists_of(items).join(kept, list(S.DISPOSITION), "left_semi")


def missing_regions(processed: DataFrame) -> DataFrame:
    """How many sales, of which departments, found no region."""
    return missing_totals(processed, "code_region", "code_departement")
