"""Which backend a region goes to: configured names, overrides, and a strong model for what a fast one can't do."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as t
from vellum.functions.recognizer import Recognizer, recognise

KINDS, PARSERS = ("local", "openai"), ("otsl", "latex", "text", "raw")


@dataclass(frozen=True)
class Backend:
    name: str
    kind: str
    model: str = ""
    url: str = ""
    parser: str = "raw"


@dataclass(frozen=True)
class Routing:
    """Backends by name and a backend's name, or ``default``, by modality."""

    backends: dict[str, Backend] = field(default_factory=dict)
    routes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Routing:
        """Raises ValueError for unknown kinds, parsers and names."""
        given = json.loads(text)
        backends = {}
        for name, spec in given.get("backends", {}).items():
            backend = Backend(name, spec.get("kind", "local"), spec.get("model", ""), spec.get("url", ""), spec.get("parser") or "raw")
            if backend.kind not in KINDS or backend.parser not in PARSERS:
                raise ValueError(f"backend {name} has an unknown kind or parser")
            if backend.kind == "openai" and not backend.url:
                raise ValueError(f"backend {name} has no url")
            backends[name] = backend
        routes = dict(given.get("routes", {}))
        if unknown := {x for x in routes.values() if x != "default"} - backends.keys():
            raise ValueError(f"routes name unknown backends: {sorted(unknown)}")
        return cls(backends, routes)

    def resolve(self, modality: str, override: str = "") -> Backend | None:
        """An override comes first, then the route; None is the built-in backend."""
        if override:
            if override not in self.backends:
                raise ValueError(f"no backend is called {override}")
            return self.backends[override]
        return self.backends.get(self.routes.get(modality, "default"))

    def routable(self, modality: str) -> set[str]:
        """Names that a request may give."""
        route = self.routes.get(modality, "default")
        return {n for n, b in self.backends.items() if b.kind == "openai"} | ({route} - {"default"})


def resolved(routing: Routing, modality: Column, override: Column) -> Column:
    """R8 as a column: the backend's name, null for the built-in one, ``ROUTING_UNKNOWN_OVERRIDE`` for unknown overrides."""
    route = F.lit(None).cast("string")
    for name, target in routing.routes.items():
        route = F.when(modality == name, F.lit(None if target == "default" else target)).otherwise(route)
    return F.when(override != "", F.when(override.isin(*routing.backends) if routing.backends else F.lit(False), override).otherwise("ROUTING_UNKNOWN_OVERRIDE")).otherwise(route)


def cascade(crops: DataFrame, fast: Callable[[], Recognizer], strong: Callable[[], Recognizer]) -> DataFrame:
    """All crops by the fast model; those with CJK text in its reply, or on a page that has it (``page_is_cjk``), again by the strong one."""
    first = recognise(crops, fast).join(crops.select("page_id", "region_id", "page_is_cjk"), ["page_id", "region_id"])
    again = first.where(F.col("error").isNull() & (F.col("page_is_cjk") | t.contains_cjk(F.col("text")))).select("page_id", "region_id")
    second = recognise(crops.join(again, ["page_id", "region_id"]), strong).select("page_id", "region_id", F.col("text").alias("better"), F.col("error").alias("failed"))
    out = first.join(second, ["page_id", "region_id"], "left")
    return out.select("page_id", "region_id", F.when(F.col("failed").isNull(), F.coalesce("better", "text")).otherwise(F.col("text")).alias("text"), F.col("better").isNotNull().alias("escalated"))


def label_dictionary(lines: DataFrame) -> DataFrame:
    """(idx, ch) from the numbered lines of a dictionary file: blank first, a space last. The file has as many rows as a script has characters."""
    kept = lines.select((F.col("idx") + 1).alias("idx"), F.regexp_replace("value", r"\r$", "").alias("ch"))
    ends = lines.agg(F.max("idx").alias("n")).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("idx"), F.lit("").alias("ch")), F.struct((F.coalesce("n", F.lit(-1)) + 2).cast("long").alias("idx"), F.lit(" ").alias("ch")))).alias("e"))
    return kept.select(F.col("idx").cast("long").alias("idx"), "ch").unionByName(ends.select("e.idx", "e.ch"))


def tokenizer_vocabulary(files: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(id, token, special) from a tokenizer file's JSON in ``value``; added tokens replace those of the model, and ids beyond the cap are left out."""
    parsed = files.select(F.from_json("value", "model struct<vocab:map<string,bigint>>, added_tokens array<struct<id:bigint,content:string,special:boolean>>").alias("j"))
    plain = parsed.select(F.explode("j.model.vocab").alias("token", "id")).select("id", "token", F.lit(False).alias("special"), F.lit(0).alias("rank"))
    added = parsed.select(F.explode("j.added_tokens").alias("a")).select("a.id", F.col("a.content").alias("token"), F.coalesce("a.special", F.lit(False)).alias("special"), F.lit(1).alias("rank"))
    best = F.max_by(F.struct("token", "special"), "rank")
    return plain.unionByName(added).where(F.col("id").between(0, most)).groupBy("id").agg(best.alias("b")).select("id", "b.token", "b.special")


# What a service is asked at, and modes of reading PDF pages.
ENDPOINTS = ("/health", "/health/live", "/health/ready", "/metrics", "/capabilities", "/ocr", "/ocr/raw", "/ocr/batch", "/ocr/pixels", "/ocr/pdf")
ACCELERATED = ("/ocr/markdown", "/infer", "/ocr/stream")


def capabilities(routing: Routing, accelerated: bool, features: dict[str, bool], limits: dict[str, int], default_dpi: int = 100, max_pages: int = 2000, verified: bool = True, profiled: bool = False, response_mode: str = "structured") -> str:
    """What a service offers, as one JSON document. Of backends it names no more than their kinds."""
    modes = ["ocr", "geometric", "auto"] + ["auto_verified"] * verified
    offered = {k: bool(features.get(k)) for k in ("layout", "tables", "formulas", "autorotate")} | {"profile_endpoint": profiled, "grpc_response_mode": response_mode}
    named = {"routes": dict(sorted(routing.routes.items())), "backends": {k: {"kind": b.kind} for k, b in sorted(routing.backends.items())}}
    whole = {"build": "gpu" if accelerated else "cpu", "features": offered, "pdf": {"modes": modes, "default_dpi": default_dpi, "max_pages": max_pages}}
    whole |= {"limits": {k: limits[k] for k in ("max_body_mb", "max_image_dim", "max_batch_images")}, "endpoints": [*ENDPOINTS, *(ACCELERATED if accelerated else ()), *(("/profile",) if profiled else ())], "routing": named}
    return json.dumps(whole, separators=(",", ":"), ensure_ascii=False)
