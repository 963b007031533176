"""Column profiles from one scan, and semantic types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the classifier.
LOW_DISTINCT, LOW_RATIO, MID_DISTINCT, MID_RATIO = 50, 0.005, 500, 0.05
CAST_RATIO, CODE_DISTINCT, ID_DISTINCT, ID_RATIO = 0.95, 20, 10_000, 0.5
NUMERIC_TYPES = ("tinyint", "smallint", "int", "integer", "bigint", "float", "double", "decimal", "real")
INTEGER_TYPES = ("tinyint", "smallint", "int", "integer", "bigint")
DATE_TYPES = ("date", "timestamp", "timestamp_ntz", "timestamp with time zone")
TEXT_TYPES = ("string", "varchar", "char", "binary", "varbinary")
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def base_type(name: str) -> str:
    return name.strip().lower().partition("(")[0].strip()


def castable(column: Column) -> Column:
    """Text that reads as a number; suffixes of types don't count."""
    return column.cast("string").rlike(_NUMBER)


def column_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: counts, distinct values, numbers among text. One aggregate over one scan, then unpivoted.

    Days and times are not read; types that are neither numbers, days nor text get counts only.
    """
    aggs, rows = [F.count("*").alias("_n")], []
    for i, f in enumerate(df.schema.fields):
        kind = base_type(f.dataType.simpleString())
        c = F.col(f"`{f.name}`")
        name, physical = F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("physical_type")
        if kind in DATE_TYPES:
            counts = [F.lit(None).cast("long")] * 3
        else:
            flat = kind in NUMERIC_TYPES or kind in TEXT_TYPES
            distinct = (F.count_distinct(c) if exact else F.approx_count_distinct(c)) if flat else F.lit(None).cast("long")
            aggs += [F.count(c).alias(f"_nn{i}"), distinct.alias(f"_d{i}") if flat else F.max(F.lit(None).cast("long")).alias(f"_d{i}")]
            if kind in TEXT_TYPES:
                aggs.append(F.count_if(castable(c)).alias(f"_c{i}"))
            counts = [F.col(f"_nn{i}"), F.col(f"_d{i}"), F.col(f"_c{i}") if kind in TEXT_TYPES else F.lit(0).cast("long")]
        rows.append(F.struct(F.lit(i).alias("position"), name, physical, F.lit(kind).alias("base_type"), F.col("_n").alias("total_count"), counts[0].alias("non_null_count"), counts[1].alias("distinct_count"), counts[2].alias("castable_count")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def classified(stats: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Adds ratios, the type by content, the type that cardinality suggests for numbers, overrides, and warnings."""
    d, nn, cast = F.col("distinct_count"), F.col("non_null_count"), F.col("castable_count")
    is_number, is_day, is_text = (F.col("base_type").isin(*t) for t in (NUMERIC_TYPES, DATE_TYPES, TEXT_TYPES))
    ratio, cast_ratio = _ratio("distinct_count", "non_null_count"), _ratio("castable_count", "non_null_count")
    by_content = (
        F.when(is_number, "NUMERIC").when(is_day, "DATETIME").when(~is_text | (nn == 0), "UNKNOWN")
        .when((cast > 0) & (cast_ratio >= CAST_RATIO) & (d >= ID_DISTINCT) & (ratio >= ID_RATIO), "IDENTIFIER")
        .when((cast > 0) & (cast_ratio >= CAST_RATIO) & (d <= CODE_DISTINCT), "CATEGORICAL_LOW")
        .when((cast > 0) & (cast_ratio >= CAST_RATIO), "NUMERIC")
        .when((d <= LOW_DISTINCT) & (ratio < LOW_RATIO), "CATEGORICAL_LOW")
        .when((d <= MID_DISTINCT) & (ratio < MID_RATIO), "CATEGORICAL_MID")
        .otherwise("CATEGORICAL_HIGH")
    )
    counted = is_number & (nn > 0) & (d > 0)
    suggested = F.when(counted & (d <= CODE_DISTINCT), "CATEGORICAL_LOW").when(counted & F.col("base_type").isin(*INTEGER_TYPES) & (d >= ID_DISTINCT) & (ratio >= ID_RATIO), "IDENTIFIER")
    forced = F.lit(None).cast("string")
    for name, kind in (overrides or {}).items():
        forced = F.when(F.col("column_name") == name, kind).otherwise(forced)
    null_ratio = F.when(F.col("total_count") > 0, 1 - nn / F.col("total_count")).otherwise(F.lit(0.0))
    warnings = F.filter(
        F.array(
            F.when(F.col("total_count") == 0, "empty sample"), F.when(null_ratio > 0.5, "mostly null"), F.when(F.col("total_count").between(1, 99), "fewer than 100 rows"),
            F.when(counted & (d == 1), "constant number").when(counted & (d <= CODE_DISTINCT), "few distinct numbers"),
        ), lambda x: x.isNotNull(),
    )
    out = stats.withColumns({"null_ratio": null_ratio, "distinct_ratio": ratio, "numeric_cast_ratio": cast_ratio, "inferred_type": by_content, "suggested_type": suggested, "override_type": forced, "warnings": warnings})
    return out.withColumn("semantic_type", F.coalesce("override_type", "suggested_type", "inferred_type"))


def excluded(profile: DataFrame) -> DataFrame:
    """Columns that get no statistical rules, with the reason; high null ratios get no completeness rule."""
    kind = F.col("semantic_type")
    reason = F.when(kind == "DATETIME", "time axis").when(kind == "IDENTIFIER", "identifier").when(kind == "UNKNOWN", "unknown content").when(kind == "CATEGORICAL_HIGH", "too many categories").when(F.col("null_ratio") > 0.10, "too many nulls")
    return profile.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("column_name", "semantic_type", "reason")


#: What a name's beginnings, ends and parts hint at, by priority of the hints.
NAME_HINTS = {
    "identifier": (("id_", "sk_", "pk_", "nr_", "num_"), ("_id", "_sk", "_pk", "_cpf", "_cnpj"), ("cpf", "cnpj", "contrato", "matricula", "protocolo", "num_doc", "nr_doc", "documento")),
    "date": (("dt_", "dat_", "data_", "date_"), ("_dt", "_data", "_date"), ("aniversario", "nascimento", "vencimento", "abertura")),
    "flag": (("ind_", "flag_", "fl_", "is_", "has_", "tem_"), ("_flag", "_ind"), ("ativo", "inativo", "habilitado")),
    "amount": (("vlr_", "val_", "amt_", "preco_", "saldo_", "mnt_"), ("_vlr", "_val", "_saldo"), ()),
    "quantity": (("qtd_", "qtde_", "qty_", "cnt_"), ("_qtd", "_qtde", "_qty"), ()),
    "percentage": (("pct_", "perc_", "taxa_", "aliq_"), ("_pct", "_perc", "_taxa"), ()),
    "code": (("cod_", "cd_", "tp_", "tipo_"), ("_cod", "_cd", "_tipo", "_tp"), ("sigla", "uf", "segmento")),
    "text": (("nom_", "nome_", "desc_", "obs_", "txt_", "motivo_", "razao_"), ("_nome", "_desc", "_descricao", "_obs"), ()),
}


def hint_pattern(hint: str) -> str:
    """One regular expression for a hint's beginnings, ends and parts."""
    begins, ends, parts = NAME_HINTS[hint]
    return "|".join([*(f"^{x}" for x in begins), *(f"{x}$" for x in ends), *parts])


def name_hints(stats: DataFrame) -> DataFrame:
    """column_name, hints, strongest: what the names of columns suggest, strongest first."""
    name = F.lower(F.trim("column_name"))
    hints = F.filter(F.array(*[F.when(name.rlike(hint_pattern(h)), h) for h in NAME_HINTS]), lambda x: x.isNotNull())
    return stats.select("column_name", hints.alias("hints")).withColumn("strongest", F.try_element_at("hints", F.lit(1)))
