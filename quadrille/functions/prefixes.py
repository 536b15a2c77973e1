"""Prefixes of IRIs. [D8, N-07..N-09, P-19]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The prefixes that are known from the start.
DEFAULTS = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dc": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "schema": "https://schema.org/",
    "prov": "http://www.w3.org/ns/prov#",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "dbo": "http://dbpedia.org/ontology/",
    "dbp": "http://dbpedia.org/property/",
    "dbr": "http://dbpedia.org/resource/",
}


class Prefixes:
    """A small dictionary, prefix to base, that turns into expressions."""

    def __init__(self, more: dict[str, str] | None = None, defaults: bool = True):
        self.bases: dict[str, str] = dict(DEFAULTS) if defaults else {}
        for prefix, base in (more or {}).items():
            self.add(prefix, base)

    def add(self, prefix: str, base: str) -> None:
        """A prefix that is taken keeps its base. [N-09]"""
        if prefix not in self.bases:
            self.bases[prefix] = base

    def _by_base(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for prefix, base in self.bases.items():
            out.setdefault(base, prefix)
        return out

    def compact_text(self, iri: str) -> str:
        """get_prefixed of one IRI, on the driver and in parsers. [N-07]"""
        by_base = self._known
        cut = max(iri.rfind("#"), iri.rfind("/")) + 1
        if cut:
            if (p := by_base.get(iri[:cut])) is not None:
                return f"{p}:{iri[cut:]}"
            again = iri.rfind("/", 0, cut - 1) + 1
            if again and (p := by_base.get(iri[:again])) is not None:
                return f"{p}:{iri[again:]}"
        return iri

    @property
    def _known(self) -> dict[str, str]:
        return self._by_base()

    def _lookup(self, base: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in self._by_base().items() for x in pair]) if self.bases else F.lit(None).cast("map<string,string>")
        return F.try_element_at(table, base)

    def compact(self, iri: Column, levels: int = 2) -> Column:
        """prefix:local where the part up to the last '#' or '/', or else up to the '/' before, is a known base;
        else the IRI. [N-07; one level: N-08]"""
        base1 = F.regexp_extract(iri, r"^(.*[#/])[^#/]*$", 1)
        made = F.when(self._lookup(base1).isNotNull(), F.concat(self._lookup(base1), F.lit(":"), F.substring(iri, F.length(base1) + 1, F.length(iri))))
        if levels > 1:
            base2 = F.regexp_extract(iri, r"^(.*/)[^/]*[#/][^#/]*$", 1)
            made = made.when((base2 != "") & self._lookup(base2).isNotNull(), F.concat(self._lookup(base2), F.lit(":"), F.substring(iri, F.length(base2) + 1, F.length(iri))))
        return made.otherwise(iri)

    def compact_or_null(self, iri: Column) -> Column:
        """get_prefixed_opt: one level only, null if unknown. [N-08]"""
        one = self.compact(iri, 1)
        return F.when(one != iri, one)

    def expand(self, name: Column) -> Column:
        """get_full_opt: the full IRI of prefix:local, split at the first ':'; null if unknown. [N-08]"""
        table = F.create_map(*[F.lit(x) for pair in self.bases.items() for x in pair])
        at = F.instr(name, ":")
        base = F.try_element_at(table, F.substring(name, F.lit(1), at - 1))
        return F.when(at > 0, F.concat(base, F.substring(name, at + 1, F.length(name))))

    def has_known_prefix(self, iri: Column) -> Column:
        return self.compact_or_null(iri).isNotNull()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.bases.items()), "prefix string, base string")
