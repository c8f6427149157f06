"""The observation service's computations as functions: counts, pages, downloads and the catalog.

A query id is a hash of the form, so equal forms share an id and nothing needs a server's memory.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, filters, results
from .plans.spec import QuerySpec, filter_text, spec_from_form
from .schemas import POINT_COLUMNS
from .sources import files
from .sources.tables import Store


def query_id(form: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(form, sort_keys=True).encode()).hexdigest()[:8]


def missing_point_columns(header: Sequence[str]) -> list[str]:
    """Columns that an uploaded point table lacks."""
    return files.missing_columns(header, POINT_COLUMNS)


#: Values of a covariate that the form offers at most; more are found by typing.
MOST_VALUES = 10_000


class ObservationService:
    """Answers forms over a store; ``remember`` keeps forms by id in a mapping of the caller's choice."""

    def __init__(self, store: Store, remember: dict[str, Mapping[str, object]] | None = None) -> None:
        self.store, self.forms = store, {} if remember is None else remember
        self._names: dict[int, list[tuple[str, float]]] = {}

    def process_query(self, form: Mapping[str, object]) -> str:
        key = query_id(form)
        spec_from_form(form)
        self.forms[key] = form
        return key

    def selected(self, spec: QuerySpec) -> DataFrame:
        return filters.apply_spec(self.store, spec)

    def n_samples(self, form: Mapping[str, object]) -> dict[str, object]:
        spec = spec_from_form(form)
        row = filters.count_samples_studies(self.selected(spec)).first()
        known = {k: v[1] for k, v in filters.associations(self.store, [n for n, _ in spec.covariates]).items()}
        return {"sample_count": row["sample_count"], "study_count": row["study_count"], "filter_text": filter_text(spec, known)}

    def columns(self, level: int) -> list[tuple[str, float]]:
        """Names and display orders of the covariates that a table shows; the catalog is small."""
        if level not in self._names:
            self._names[level] = [(r["name"], r["display_order"]) for r in catalog.display_columns(self.store, level).collect()]
        return self._names[level]

    def get_data(self, key: str, offset: int = 0, limit: int = 100) -> dict[str, object]:
        """A page: columns in display order, sample and study rows as JSON lines, and whether more follow."""
        fact = self.selected(spec_from_form(self.forms[key]))
        shown = self.columns(results.SAMPLE_LEVEL)
        names = [n for n, _ in shown]
        samples = results.page_samples(self.store, fact, offset, limit, names)
        studies = results.page_studies(fact, offset, limit)
        return {
            "sample_columns": results.column_order(names, dict(shown), results.SAMPLE_COLUMNS),
            "samples": [json.loads(r.value) for r in files.json_rows(samples.orderBy("row_number")).collect()],
            "studies": [json.loads(r.value) for r in files.json_rows(studies.orderBy("row_number")).collect()],
            "has_more": results.has_more(fact, offset, limit).first()["has_more"],
        }

    def tables(self, key: str, all_columns: bool = False) -> dict[str, DataFrame]:
        """The wide tables of a download; study columns are those of the selected studies unless ``all_columns``."""
        fact = self.selected(spec_from_form(self.forms[key]))
        sample_names = [r["name"] for r in results.covariate_names(self.store, results.SAMPLE_LEVEL, fact).collect()]
        study_names = [r["name"] for r in results.covariate_names(self.store, results.STUDY_LEVEL, None if all_columns else fact).collect()]
        return {"samples.csv": results.export_samples(self.store, fact, sample_names), "studies.csv": results.export_studies(self.store, fact, study_names)}

    def download(self, key: str, path: str | Path) -> None:
        """A ZIP for a person; a pipeline writes ``tables`` as Parquet instead."""
        files.write_zip(self.tables(key), str(path), {"samples.csv": "None"})

    def search_fields(self) -> dict[str, object]:
        """What the query form offers: values or a type for each covariate, and the places."""
        values = {r["name"]: r["values"] for r in catalog.searchable_values(self.store, MOST_VALUES).collect()}
        types = {r["name"]: r["type_name"] for r in catalog.continuous_covariates(self.store).collect()}
        of = {k: sorted(r[0] for r in catalog.places(self.store, k).collect()) for k in ("COUNTRY", "CONTINENT")}
        return {"covariates": values | types, "countries": of["COUNTRY"], "continents": of["CONTINENT"], "sample_count": self.store.sample.count()}

    def save_fields(self, path: str, clear: bool = False) -> DataFrame:
        """The searchable values kept as a table; computed anew if ``clear`` or absent."""
        spark: SparkSession = self.store.spark
        if not clear:
            try:
                return spark.read.parquet(path)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        catalog.searchable_values(self.store).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def update_covariate(self, changes: Sequence[tuple], schema: str) -> DataFrame:
        """The listing after changes to definitions; the store answers with them from now on."""
        new = catalog.update_covariates(self.store.covariate_defn, self.store.spark.createDataFrame(list(changes), schema))
        self.store.given["covariate_defn"] = new
        self._names.clear()
        return catalog.covariate_listing(self.store).orderBy(F.col("position"))
