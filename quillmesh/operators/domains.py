"""Domains as a table: built-in ones, those of frameworks and a user's own, and their configuration.

A configuration is a JSON document with `customDomains` and `disabledDomains`; edits are pure functions
from one configuration to the next, and the table is the union of the sources in which a later source
replaces a domain of the same name."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Domains of frameworks and the words that indicate them.
LARAVEL = {
    "eloquent": ["eloquent", "model", "relation", "scope", "accessor", "mutator", "cast", "factory", "seeder", "hasMany", "belongsTo", "morphTo"],
    "blade": ["blade", "template", "view", "component", "slot", "directive", "layout", "section", "yield"],
    "artisan": ["artisan", "command", "console", "schedule", "cron", "tinker"],
    "filament": ["filament", "resource", "widget", "page", "panel", "admin", "form", "infolist"],
    "livewire": ["livewire", "wire", "alpine", "reactive", "emit", "dispatch"],
    "nova": ["nova", "resource", "lens", "action", "filter", "metric", "card"],
    "sanctum": ["sanctum", "token", "ability", "personalAccessToken", "spa"],
    "horizon": ["horizon", "supervisor", "balance", "queue", "redis"],
}
NODE = {
    "express": ["express", "router", "middleware", "req", "res", "next", "app.use", "app.get", "app.post"],
    "prisma": ["prisma", "schema", "migration", "client", "model", "findMany", "create", "update", "delete"],
    "nextjs": ["nextjs", "getServerSideProps", "getStaticProps", "getStaticPaths", "useRouter", "Image", "Link", "Head", "app router", "page router"],
    "nestjs": ["nestjs", "@nestjs", "@Controller", "@Injectable", "@Module", "@Guard", "@Pipe", "@Interceptor", "@Get", "@Post", "@Put", "@Delete", "@Patch"],
    "react": ["react", "useState", "useEffect", "useContext", "useReducer", "useMemo", "useCallback", "useRef", "component", "jsx", "tsx"],
    "redux": ["redux", "store", "reducer", "action", "dispatch", "selector", "slice", "thunk", "saga", "toolkit"],
    "vue": ["vue", "ref", "reactive", "computed", "watch", "onMounted", "defineComponent", "setup", "template"],
    "graphql": ["graphql", "query", "mutation", "subscription", "resolver", "schema", "type", "apollo", "gql"],
}


@dataclass(frozen=True)
class Config:
    custom: dict[str, list[str]] = field(default_factory=dict)
    disabled: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str | None) -> Config:
        """A missing or broken document is an empty configuration."""
        try:
            doc = json.loads(text or "{}")
            return cls({d["name"]: list(d.get("keywords", [])) for d in doc.get("customDomains", [])}, tuple(doc.get("disabledDomains", [])))
        except (ValueError, TypeError, KeyError, AttributeError):
            return cls()

    def dump(self) -> str:
        return json.dumps({"customDomains": [{"name": n, "keywords": ws} for n, ws in self.custom.items()], "disabledDomains": list(self.disabled)}, indent=2)

    def put(self, name: str, words: list[str]) -> Config:
        return replace(self, custom=self.custom | {name: words})

    def drop(self, name: str) -> Config:
        return replace(self, custom={n: ws for n, ws in self.custom.items() if n != name})

    def disable(self, name: str) -> Config:
        return replace(self, disabled=tuple(dict.fromkeys((*self.disabled, name))))

    def enable(self, name: str) -> Config:
        return replace(self, disabled=tuple(n for n in self.disabled if n != name))


def rows(spark: SparkSession, domains: dict[str, list[str]], source: str, ord_: int) -> DataFrame:
    """domain, words, source, source_ord, ord."""
    return spark.createDataFrame([(d, ws, source, ord_, i) for i, (d, ws) in enumerate(domains.items())], "domain string, words array<string>, source string, source_ord int, ord int")


def union(*sources: DataFrame) -> DataFrame:
    """One row per domain: that of the latest source."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    latest = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("source_ord"), "ord"))
    return every.withColumn("rn", latest).filter("rn = 1").drop("rn")


def active(spark: SparkSession, core: dict[str, list[str]], frameworks: dict[str, dict[str, list[str]]], config: Config) -> DataFrame:
    """The domains in force: core, those of the given frameworks, the user's own, without the disabled."""
    parts = [rows(spark, core, "core", 0), *(rows(spark, ds, name, 1) for name, ds in frameworks.items()), rows(spark, config.custom, "custom", 2)]
    off = spark.createDataFrame([(n,) for n in config.disabled], "domain string")
    return union(*parts).join(off, "domain", "left_anti")
