"""From titles and model replies to clean attributes: rules first, a model for what they leave open.

A model is any object with generate(prompts: list[str]) -> list[tuple[reply, input_tokens, output_tokens]]. Tasks make
their own from a function that is shipped with them, so a lost executor only repeats its batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import attributes as A
from ..functions import texts as X
from ..functions import titles as T
from ..functions import validation
from ..functions import variants as V

# What a classifier may answer, fields whose placeholders go, and confidences.
COMPONENTS = ["ram", "drive", "server", "cpu", "nic", "gpu", "workstation", "desktop", "other"]
PLACEHOLDER_FIELDS = ["form_factor", "type", "interface", "port_type"]
DEFAULT_CONFIDENCE, ACCESSORY_CONFIDENCE = 0.5, 0.95


def normalized(component: Column, title: Column, attrs: Column) -> Column:
    """Attributes with units, spellings and speeds put right and placeholders dropped.

    attrs is MAP<STRING, VARIANT>; null stays null. A confidence that is null in the JSON counts as given.
    """
    return V.once({"attrs": attrs}, lambda x: with_rules(component, title, x["attrs"]))


def with_rules(component: Column, title: Column, attrs: Column) -> Column:
    texts = ["model", "family", "vendor", "line", "condition", *PLACEHOLDER_FIELDS]
    speed = V.whole(attrs, "speed_mhz")
    said = {k: V.text(attrs, k) for k in texts} | {"speed": speed, "capacity": V.whole(attrs, "capacity_gb"), "vram": V.whole(attrs, "vram_gb")}
    said |= {"found": F.when((component == "ram") & ~F.coalesce(speed.between(800, 8400), F.lit(False)), T.title_speed(title))}
    return V.once(said, lambda x: with_members(component, title, attrs, x))


def with_members(component: Column, title: Column, attrs: Column, x: Column) -> Column:
    """attrs as the rules have them, from what x says of its members."""
    ram, gpu, system = component == "ram", component == "gpu", component.isin("workstation", "desktop")
    kept, found = F.when(x["speed"].between(800, 8400), x["speed"]), x["found"]
    model, family, vendor, line = (x[k] for k in ("model", "family", "vendor", "line"))
    new_line = A.system_line(F.coalesce(line, F.lit("")), F.coalesce(model, F.lit("")))
    changes = {
        "confidence": F.when(~F.map_contains_key(attrs, "confidence"), F.lit(DEFAULT_CONFIDENCE)),
        "condition": F.when(x["condition"].isNotNull(), T.condition(x["condition"])),
        "capacity_gb": F.when(ram, A.fewer_units(x["capacity"], 1024)),
        "speed_mhz": F.when(ram, found),
        "tier": F.when(component == "server", T.server_tier(title)),
        "vram_gb": F.when(gpu, A.gpu_vram(x["vram"])),
        "model": F.when(gpu, A.gpu_model(model)).when(system, A.system_model(model)),
        "family": F.when(gpu & (model.isNotNull() | family.isNotNull()), A.gpu_family(F.coalesce(family, F.lit("")), F.coalesce(model, F.lit("")))),
        "vendor": F.when(system, A.system_vendor(vendor)),
        "line": F.when(system, new_line),
    }
    changes = {k: F.nullif(v, F.lit("")) if k in ("family", "line") else v for k, v in changes.items()}
    stale = [F.when(x[k].isNotNull() & A.without_placeholder(X.trimmed(x[k])).isNull(), k) for k in PLACEHOLDER_FIELDS]
    stale.append(F.when(ram & kept.isNull() & found.isNull(), "speed_mhz"))
    return V.edited(attrs, changes, F.array_compact(F.array(*stale)))


def key_attributes(attrs: Column) -> dict[str, Column]:
    """Typed members that product keys are made of."""
    texts = "generation interface form_factor capacity type manufacturer model drive_form_factor tier family speed port_type vendor line".split()
    out = {k: V.text(attrs, k) for k in texts} | {k: V.whole(attrs, k) for k in ("capacity_gb", "speed_mhz", "port_count", "vram_gb", "rpm")}
    flag = lambda k: F.when(F.schema_of_variant(F.try_element_at(attrs, F.lit(k))) == "BOOLEAN", F.try_variant_get(F.try_element_at(attrs, F.lit(k)), "$", "boolean"))
    return out | {"ecc": flag("ecc"), "registered": flag("registered")}


def preclassified(title: Column, specifics: Column) -> Column:
    """What rules know before a model is asked: systems by title, accessories, systems by specifics; else null."""
    by_title, by_specifics = F.nullif(T.system_type(title), F.lit("")), F.nullif(X.system_of(specifics), F.lit(""))
    return F.coalesce(by_title, F.when(T.accessory_only(title), "other"), by_specifics)


def ask(rows: DataFrame, prompt: str, make_model: Callable[[], object], batch: int = 32) -> DataFrame:
    """Rows with columns reply, input_tokens and output_tokens for their prompt; a null prompt asks nothing."""
    schema = StructType(list(rows.schema.fields)).add("reply", "string").add("input_tokens", "long").add("output_tokens", "long")

    def run(frames: Iterator) -> Iterator:
        model = make_model()
        for frame in frames:
            asked = frame.index[frame[prompt].notna()]
            got = {}
            for k in range(0, len(asked), batch):
                part = asked[k : k + batch]
                got.update(zip(part, model.generate(list(frame.loc[part, prompt])), strict=True))
            answers = [got.get(i, (None, None, None)) for i in frame.index]
            for name, values in zip(("reply", "input_tokens", "output_tokens"), zip(*answers, strict=True) if answers else ((), (), ()), strict=True):
                frame[name] = list(values)
            for name in ("input_tokens", "output_tokens"):
                frame[name] = frame[name].astype("Int64")
            yield frame

    return rows.mapInPandas(run, schema)


def classify(rows: DataFrame, template: str, make_model: Callable[[], object]) -> DataFrame:
    """Rows (title, specifics) with component; the model sees only titles that no rule settles. An answer that is
    no component gives null."""
    known = rows.withColumn("known", preclassified(F.col("title"), F.col("specifics")))
    asked = ask(known.withColumn("prompt", F.when(F.col("known").isNull(), X.filled(template, {"title": F.col("title")}))), "prompt", make_model)
    answer = F.lower(X.trimmed(F.col("reply")))
    return asked.withColumn("component", F.coalesce("known", F.when(answer.isin(COMPONENTS), answer))).drop("known", "prompt", "reply")


def extract(rows: DataFrame, templates: dict[str, str], make_model: Callable[[], object]) -> DataFrame:
    """Rows (title, specifics, component) with attributes and error. Accessories (other) need no model.

    templates gives the prompt of each component, with {title} and {specifics}. attributes is JSON text, null where the
    reply is no JSON object; error is the first broken rule.
    """
    fields = {"title": F.col("title"), "specifics": X.specifics_text(F.col("specifics"))}
    prompt = F.lit(None).cast("string")
    for component, template in templates.items():
        prompt = F.when(F.col("component") == component, X.filled(template, fields)).otherwise(prompt)
    asked = ask(rows.withColumn("prompt", prompt), "prompt", make_model)
    clean = normalized(F.col("component"), F.col("title"), V.attributes(X.unfenced(F.col("reply"))))
    accessory = (F.col("component") == "other") & F.col("prompt").isNull()
    attrs = F.when(accessory, F.create_map(F.lit("confidence"), F.lit(ACCESSORY_CONFIDENCE).cast("variant"))).otherwise(clean)
    out = asked.withColumn("attrs", attrs)
    error = F.when(accessory, None).when(F.col("attrs").isNull(), "no JSON object").otherwise(validation.first_error(F.col("component"), F.col("attrs")))
    return out.withColumns({"error": error, "attributes": F.to_json("attrs")}).drop("prompt", "reply", "attrs")


def judged(alerts: DataFrame, template: str, fields: dict[str, Column], make_model: Callable[[], object]) -> DataFrame:
    """U4: alerts with score and reason of the judge, null where the reply cannot be read. Fields are made harmless."""
    prompt = X.filled(template, {k: X.harmless(v.cast("string")) for k, v in fields.items()})
    verdict = X.parsed_verdict(F.col("reply"))
    asked = ask(alerts.withColumn("prompt", prompt), "prompt", make_model)
    return asked.withColumns({"judge_score": verdict["score"], "judge_reason": verdict["reason"]}).drop("prompt", "reply")


def reclassified(listings: DataFrame) -> DataFrame:
    """Active rows whose title names an accessory and no machine become other."""
    hit = F.col("active") & F.coalesce(T.says(F.col("title"), T.ACCESSORY) & ~T.says(F.col("title"), T.PRIMARY), F.lit(False))
    return listings.withColumns({
        "component_type": F.when(hit, "other").otherwise(F.col("component_type")),
        "confidence": F.when(hit, ACCESSORY_CONFIDENCE).otherwise(F.col("confidence")),
    })


def promoted(listings: DataFrame) -> DataFrame:
    """Active rows of other whose title names a graphics card become gpu."""
    hit = F.col("active") & (F.col("component_type") == "other") & T.says(F.col("title"), T.GRAPHICS)
    return listings.withColumn("component_type", F.when(hit, "gpu").otherwise(F.col("component_type")))


def with_tier(listings: DataFrame) -> DataFrame:
    """Keys of active servers end in their tier; those that do already stay."""
    ends = F.rlike("product_key", F.lit(":(barebone|partial|configured)$"))
    hit = F.col("active") & (F.col("component_type") == "server") & ~ends
    return listings.withColumn("product_key", F.when(hit, F.concat_ws(":", "product_key", T.server_tier(F.col("title")))).otherwise(F.col("product_key")))


def tier_of_key(key: Column) -> Column:
    """P13."""
    return F.when(F.endswith(key, F.lit(":barebone")), "barebone").when(F.endswith(key, F.lit(":configured")), "configured").when(F.endswith(key, F.lit(":partial")), "partial").otherwise("unknown")
