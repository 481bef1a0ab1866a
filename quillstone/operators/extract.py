"""Field extraction as rows: document_id, field, value_ord, value, and the citation it rests on."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import text as T
from quillstone.operators import trust

SINGLE = ("organization_name", "document_type", "effective_date", "renewal_date")


def entries(chunks: DataFrame) -> DataFrame:
    """One row a line that may be used: chunk columns, at (its order in the document) and line."""
    lines = F.transform(F.split("text", r"\r\n|[\n\r]"), T.strip)
    wanted = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    safe = trust.admitted(chunks.withColumn("_lines", wanted), "_lines")
    # Not posexplode(): the optimiser would derive a filter from it that evaluates the whole array once more.
    rows = safe.select("document_id", "chunk_id", "page", "ordinal", F.posexplode_outer("_lines").alias("line_at", "line")).where("line IS NOT NULL")
    return rows.withColumn("at", F.struct("ordinal", "line_at"))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iuU){pattern}")


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?iuU){pattern}", group), F.lit(""))


def labelled(line: Column, labels: tuple[str, ...]) -> Column:
    """What follows a label and a colon or dash; null without one."""
    names = "|".join(re.escape(x) for x in labels)
    return F.when(line.rlike("[:—-]"), _first(line, rf"^(?:{names})\s*(?::|—|-)\s*(.+?)\s*$", 1))


def _candidate(field: str, value: Column, priority: int = 0, where: Column | None = None, excerpt: Column | None = None) -> Column:
    """An array of one candidate, with a null value where the condition fails."""
    excerpt = F.col("line") if excerpt is None else excerpt
    return F.array(_struct(field, priority, F.lit(0), value if where is None else F.when(where, value), excerpt))


def _struct(field: str, priority: int, within: Column, value: Column, excerpt: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(priority).alias("priority"), within.cast("int").alias("within"), value.alias("value"), excerpt.alias("excerpt"))


def _listed(field: str, values: Column, excerpt_is_value: bool = False) -> Column:
    return F.transform(values, lambda v, i: _struct(field, 0, i, T.strip(v), T.strip(v) if excerpt_is_value else F.col("line")))


def _matches(pattern: str) -> Column:
    """Amounts in a line; each has a digit, which most lines lack."""
    return F.when(F.col("line").rlike("[0-9]"), F.regexp_extract_all("line", F.lit(f"(?iuU){pattern}"), F.lit(0))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<string>")


def _rows(lines: DataFrame, candidates: list[Column]) -> DataFrame:
    return lines.select("document_id", "chunk_id", "page", "at", F.inline_outer(F.concat(*candidates)))


def _settle(candidates: DataFrame) -> DataFrame:
    """Single fields: the first candidate of the best priority. Lists: distinct values in order of appearance."""
    order = ["priority", "at", "within"]
    numbered = candidates.withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "field", "value").orderBy(*order))).where("nth = 1")
    numbered = numbered.withColumn("value_ord", F.row_number().over(Window.partitionBy("document_id", "field").orderBy(*order)) - 1)
    kept = numbered.where((~F.col("field").isin(*SINGLE)) | (F.col("value_ord") == 0))
    return kept.select("document_id", "field", "value_ord", "value", F.struct("chunk_id", "page", "excerpt").alias("citation"))


def extract_labelled(chunks: DataFrame) -> DataFrame:
    """Fields by labels and fixed phrases. Takes document_id, chunk_id, page, ordinal, text."""
    line = F.col("line")
    rows = entries(chunks).withColumns({f"_{field}": labelled(line, labels) for field, labels in P.LABELS.items()})
    label = {field: F.col(f"_{field}") for field in P.LABELS}
    obliges = lambda text: _has(text, P.OBLIGATION)

    def dates(field: str, context: str) -> Column:
        return _candidate(field, _first(F.coalesce(label[field], line), P.EXTRACT_DATE), where=line.rlike(r"\p{Nd}") & (label[field].isNotNull() | _has(line, context)))

    risk_text = F.coalesce(label["risks"], line)
    implied = F.lit(False)
    for pattern in P.IMPLIED_RISK:
        implied = implied | risk_text.rlike(pattern)
    title = T.strip(F.regexp_replace(line, r"^#+", ""))
    upper = (F.upper(title) == title) & (F.lower(title) != title)
    titled = _candidate("document_type", title, 1, (F.col("page") == 1) & upper & _has(title, P.DOCUMENT_TITLE))
    found = _rows(
        rows,
        [
            _candidate("organization_name", label["organization_name"]),
            _candidate("organization_name", _legal_entity(line), 1, F.col("page") == 1),
            _candidate("document_type", label["document_type"]),
            titled,
            dates("effective_date", P.EFFECTIVE_CONTEXT),
            dates("renewal_date", P.RENEWAL_CONTEXT),
            _listed("important_amounts", _matches(P.EXTRACT_AMOUNT), excerpt_is_value=True),
            _candidate("obligations", F.coalesce(label["obligations"], line), where=label["obligations"].isNotNull() | obliges(line)),
            _candidate("responsible_people", _person(label["responsible_people"])),
            _candidate("risks", risk_text, where=(label["risks"].isNotNull() | implied) & ~obliges(risk_text)),
        ],
    )
    found = found.unionByName(_rows(_headings(chunks), [titled])).where("value IS NOT NULL")
    # Several renewal dates are a risk, told at the place of the first, and no date.
    whole = Window.partitionBy("document_id")
    renewal = F.col("field") == "renewal_date"
    marked = found.withColumn("_dates", F.array_sort(F.collect_set(F.when(renewal, F.col("value"))).over(whole))).withColumn("_first", F.min(F.when(renewal, F.struct("at", "within"))).over(whole))
    conflict = renewal & (F.size("_dates") > 1)
    kept = marked.where(~conflict | (F.struct("at", "within") == F.col("_first")))
    told = {"field": F.when(conflict, "risks").otherwise(F.col("field")), "priority": F.when(conflict, -1).otherwise(F.col("priority")), "value": F.when(conflict, F.concat(F.lit("Conflicting renewal dates: "), F.array_join("_dates", ", "))).otherwise(F.col("value"))}
    return _settle(kept.select("document_id", "chunk_id", "page", "at", "within", "excerpt", *(c.alias(n) for n, c in told.items())))


def _legal_entity(line: Column) -> Column:
    # The pattern tries every start of a name: most lines don't end as one must.
    return F.when(line.rlike(r"(?i)(?:ltd\.?|llc|gmbh|inc\.?)\s*$"), T.strip(_first(line, P.LEGAL_ENTITY)))


def _person(named: Column) -> Column:
    return F.regexp_replace(T.strip(F.element_at(F.split(named, ","), 1)), r"\.$", "")


def _headings(chunks: DataFrame) -> DataFrame:
    """Lines that start with #, which otherwise don't count, if each may be used by itself."""
    lines = F.transform(F.split("text", r"\r\n|[\n\r]"), T.strip)
    rows = chunks.select("document_id", "chunk_id", "page", "ordinal", F.posexplode_outer(F.filter(lines, lambda x: x.startswith("#"))).alias("line_at", "line"))
    return rows.where("line IS NOT NULL").where(~T.untrusted(F.col("line"))).withColumn("at", F.struct("ordinal", "line_at"))


def people_near_roles(line: str) -> list[str]:
    """Capitalised names with a role's verb in the forty characters that follow, or a role's noun before."""
    found = []
    for name in re.finditer(P.PERSON, line):
        if re.search(P.ROLE_VERBS, line[name.end() : name.end() + 40], re.IGNORECASE) or re.search(P.ROLE_NOUNS, line[: name.start()], re.IGNORECASE):
            found.append(name.group(1))
    return found


def _people_near_roles(lines: Column) -> Column:
    # Names are found by their place in the line, which Column functions don't give.
    @F.pandas_udf("array<string>")
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda line: people_near_roles(line) if line else [])

    return find(lines)


def extract_prose(chunks: DataFrame) -> DataFrame:
    """Fields from labels and from relations stated in prose."""
    line = F.col("line")
    labels = {**P.LABELS, **P.PROSE_LABELS}
    used = ("organization_name", "document_type", "effective_date", "renewal_date", "responsible_people")
    flags = {"_modal": P.OBLIGATION, "_lexical": P.OBLIGATION_VERBS, "_risky": P.RISK_WORDS, "_negated": P.NEGATED_OBLIGATION, "_role": P.ROLE_VERBS}
    rows = entries(chunks).withColumns({f"_{field}": labelled(line, labels[field]) for field in used} | {name: _has(line, pattern) for name, pattern in flags.items()})
    rows = rows.withColumn("_people", _people_near_roles(F.when(F.col("_role") & F.col("_responsible_people").isNull(), line)))
    label = {field: F.col(f"_{field}") for field in used}
    named = F.coalesce(*(T.strip(_first(line, pattern, 1)) for pattern in P.PROSE_ORGANIZATION), F.when(F.col("page") == 1, _legal_entity(line)))
    parts = F.filter(F.transform(F.split(line, P.TITLE_JOINT), T.strip), lambda part: _has(part, P.KIND_WORDS))
    shortest = F.array_min(F.transform(parts, lambda part, i: F.struct(F.size(F.split(part, r"\s+")).alias("words"), i.alias("i"), part.alias("part"))))["part"]
    pick = lambda text, last: F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?iuU){P.PROSE_DATE}"), F.lit(0)), F.lit(-1 if last else 1))
    bare = F.regexp_replace(F.regexp_replace(line, f"(?iuU){P.CLAUSE_OPENING}", ""), f"(?iuU){P.CLAUSE_RELATIVE}", "")
    clauses = F.filter(F.transform(F.split(bare, f"(?iuU){P.CLAUSE_JOINT}"), T.strip), lambda part: _has(part, P.OBLIGATION_VERBS))
    modal, lexical, risky = F.col("_modal"), F.col("_lexical"), F.col("_risky")
    duties = F.when(~F.col("_negated") & modal, F.array(line)).when(~F.col("_negated") & lexical & ~risky, clauses).otherwise(_none())
    found = _rows(
        rows,
        [
            _candidate("organization_name", label["organization_name"]),
            _candidate("organization_name", named, 1),
            _candidate("document_type", shortest, 0, (F.col("page") == 1) & (F.upper(line) == line)),
            _candidate("document_type", label["document_type"], 1),
            _candidate("effective_date", F.coalesce(pick(label["effective_date"], False), F.when(label["effective_date"].isNotNull(), ""))),
            _candidate("effective_date", pick(line, False), 1, _has(line, P.PROSE_EFFECTIVE)),
            _candidate("renewal_date", F.coalesce(pick(label["renewal_date"], True), F.when(label["renewal_date"].isNotNull(), ""))),
            _candidate("renewal_date", pick(line, True), 1, _has(line, P.PROSE_RENEWAL)),
            _listed("important_amounts", _matches(P.PROSE_AMOUNT)),
            _candidate("responsible_people", _person(label["responsible_people"])),
            _listed("responsible_people", F.col("_people")),
            _listed("obligations", duties),
            _candidate("risks", line, where=risky & ~modal & ~lexical),
        ],
    )
    found = found.where("value IS NOT NULL")
    # Of labelled dates only a document's first label counts, even without a date.
    nth = F.row_number().over(Window.partitionBy("document_id", "field", "priority").orderBy("at", "within"))
    dated = F.col("field").isin("effective_date", "renewal_date") & (F.col("priority") == 0)
    return _settle(found.withColumn("_nth", nth).where(~dated | ((F.col("_nth") == 1) & (F.col("value") != ""))).drop("_nth"))
