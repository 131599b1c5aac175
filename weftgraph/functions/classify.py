"""Classification of files, folders and boundary symbols, from tables of fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

#: fixed values: (class, folder names in the path, how the file's stem is tested, its words), the first that fits
FILE_CLASSES = (
    ("component", ("components", "component"), "contains", ("component",)),
    ("page", ("pages", "page", "routes"), "", ()),
    ("hook", ("hooks", "hook"), "starts", ("use",)),
    ("service", ("services", "service"), "ends", ("service",)),
    ("context", ("contexts", "context"), "ends", ("context",)),
    ("reducer", ("reducers", "reducer"), "ends", ("reducer",)),
    ("util", ("utils", "util", "helpers", "helper"), "ends", ("util", "helper")),
    ("config", ("config", "configs"), "ends", ("config", "settings", "application", "bootstrap")),
    ("type", ("types",), "ends", ("type", "types")),
)
#: fixed values: endings that decide alone
DOCUMENT_ENDINGS = (".md", ".mdx", ".markdown", ".pdf")
ASSET_ENDINGS = (".png", ".jpg", ".svg", ".ico", ".gif")
CONFIG_ENDINGS = (".properties", ".yml", ".yaml", ".toml", ".ini")
#: fixed values: (class, last segments, segments anywhere before the last)
FOLDER_CLASSES = (
    ("tests", ("tests", "test", "__tests__", "spec", "specs"), ("tests", "test", "__tests__")),
    ("documentation", ("docs", "doc", "documentation", "wiki"), ("docs", "documentation")),
    ("examples", ("examples", "example", "samples", "demo", "demos"), ("examples", "samples")),
    ("config", ("config", "configs", "settings"), ("config",)),
    ("assets", ("assets", "static", "public", "images", "img", "media"), ("assets", "static", "public")),
    ("components", ("components", "component"), ()),
    ("pages", ("pages", "page", "routes", "route"), ()),
    ("hooks", ("hooks", "hook"), ()),
    ("services", ("services", "service"), ()),
    ("contexts", ("contexts", "context"), ()),
    ("reducers", ("reducers", "reducer"), ()),
    ("utils", ("utils", "util", "helpers", "helper", "lib"), ("utils", "helpers")),
    ("types", ("types", "type", "typings"), ()),
)
CODE_LANGUAGES = ("typescript", "javascript", "python", "java")


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def classify_file(path="path", exports=None) -> Column:
    """The class of a file by its path, and by exported names (an array column) where the path says nothing; null if unknown."""
    raw = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    lower, stem = F.lower(c(path)), F.lower(raw)
    rules = [(_any(lower.endswith(e) for e in DOCUMENT_ENDINGS), "documentation")]
    rules.append((lower.contains(".test.") | lower.contains(".spec.") | stem.endswith(".test") | stem.endswith(".spec") | (lower.rlike(r"\.(java|kt)$") & (lower.contains("/test/") | raw.rlike("(Test|Tests|IT)$"))), "test"))
    for name, inside, how, words in FILE_CLASSES:
        hits = [lower.contains(f"/{x}/") for x in inside]
        hits += [getattr(stem, {"contains": "contains", "starts": "startswith", "ends": "endswith"}[how])(w) for w in words]
        if name == "page":
            hits.append((stem == "index") & lower.contains("/page"))
        if name == "config":
            hits = [stem.endswith("config"), lower.contains("/config/"), stem.endswith("settings"), *(lower.endswith(e) for e in CONFIG_ENDINGS)]
        rules.append((_any(hits), name))
    rules.append((raw.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$") | stem.rlike(r"^[0-9_]{2,}$"), "constant"))
    rules.append((_any(lower.endswith(e) for e in ASSET_ENDINGS), "asset"))
    if exports is not None:
        rules.append((F.coalesce(F.exists(c(exports), lambda e: e.endswith("Provider") | e.endswith("Context")), F.lit(False)), "context"))
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def classify_folder(path="folder", files="files", languages="languages") -> Column:
    """The class of a folder by its path, else by the languages (a map of counts) of its files; null if it has none."""
    lower = F.lower(c(path))
    last = F.regexp_extract(lower, r"([^/]*)$", 1)
    count = lambda name: F.coalesce(F.try_element_at(c(languages), F.lit(name)), F.lit(0))
    code = reduce(lambda a, b: a + b, (count(x) for x in CODE_LANGUAGES))
    out = F.when(c(files) == 0, F.lit(None)).when(count("markdown") == c(files), "documentation").when(code == c(files), "source").otherwise("mixed")
    for name, ends, inside in reversed(FOLDER_CLASSES):
        out = F.when(last.isin(*ends) | _any(lower.contains(f"/{x}/") for x in inside), name).otherwise(out)
    return out


#: fixed values: (language, id, what is matched, with what, kind, direction, protocol, where the detail comes from).
#: matches: annotation name, "*.suffix" for any receiver; supertype; call as owner.name; entry function; route; two
#: annotations as "own@owner's". details: route, call (its first string), or names of annotation arguments.
BOUNDARY_RULES = (
    ("java", "http.route", "route", "", "http.endpoint", "inbound", "http", "route"),
    ("java", "jms.JmsListener", "annotation", "JmsListener", "mq.listener", "inbound", "jms", "destination value"),
    ("java", "kafka.KafkaListener", "annotation", "KafkaListener", "mq.listener", "inbound", "kafka", "topics value"),
    ("java", "amqp.RabbitListener", "annotation", "RabbitListener", "mq.listener", "inbound", "amqp", "queues value"),
    ("java", "sqs.SqsListener", "annotation", "SqsListener", "mq.listener", "inbound", "sqs", "value"),
    ("java", "jms.MessageListener", "supertype", "MessageListener", "mq.listener", "inbound", "jms", ""),
    ("java", "spring.Scheduled", "annotation", "Scheduled", "scheduled.job", "inbound", "schedule", "cron fixedRate fixedDelay"),
    ("java", "servlet.WebServlet", "annotation", "WebServlet", "http.endpoint", "inbound", "http", "urlPatterns value"),
    ("java", "stomp.MessageMapping", "annotation", "MessageMapping", "ws.endpoint", "inbound", "websocket", "value"),
    ("java", "java.main", "entry", "main", "cli.command", "inbound", "cli", ""),
    ("java", "feign.FeignClient", "annotation", "FeignClient", "http.client", "outbound", "http", "url name value"),
    ("java", "spring.RestTemplate", "call", "RestTemplate.*", "http.client", "outbound", "http", ""),
    ("java", "spring.WebClient", "call", "WebClient.*", "http.client", "outbound", "http", ""),
    ("java", "jdk.HttpClient", "call", "HttpClient.*", "http.client", "outbound", "http", ""),
    ("java", "spring.JdbcTemplate", "call", "JdbcTemplate.*", "db.access", "outbound", "jdbc", ""),
    ("java", "jpa.EntityManager", "call", "EntityManager.*", "db.access", "outbound", "jpa", ""),
    ("java", "jpa.Repository", "supertype", "JpaRepository", "db.access", "outbound", "jpa", ""),
    ("java", "spring.CrudRepository", "supertype", "CrudRepository", "db.access", "outbound", "jpa", ""),
    ("java", "kafka.KafkaTemplate", "call", "KafkaTemplate.*", "mq.producer", "outbound", "kafka", ""),
    ("java", "jms.JmsTemplate", "call", "JmsTemplate.*", "mq.producer", "outbound", "jms", ""),
    ("java", "amqp.RabbitTemplate", "call", "RabbitTemplate.*", "mq.producer", "outbound", "amqp", ""),
    ("python", "py.route", "annotation", "*.route", "http.endpoint", "inbound", "http", "path rule"),
    ("python", "py.get", "annotation", "*.get", "http.endpoint", "inbound", "http", "path"),
    ("python", "py.post", "annotation", "*.post", "http.endpoint", "inbound", "http", "path"),
    ("python", "py.put", "annotation", "*.put", "http.endpoint", "inbound", "http", "path"),
    ("python", "py.delete", "annotation", "*.delete", "http.endpoint", "inbound", "http", "path"),
    ("python", "py.patch", "annotation", "*.patch", "http.endpoint", "inbound", "http", "path"),
    ("python", "click.command", "annotation", "*.command", "cli.command", "inbound", "cli", "name"),
    ("python", "celery.task", "annotation", "*.task", "mq.listener", "inbound", "celery", "name"),
    ("python", "celery.shared_task", "annotation", "shared_task", "mq.listener", "inbound", "celery", ""),
    ("python", "py.requests", "call", "requests.*", "http.client", "outbound", "http", ""),
    ("python", "py.httpx", "call", "httpx.*", "http.client", "outbound", "http", ""),
    ("typescript", "nest.Get", "both", "Get@Controller", "http.endpoint", "inbound", "http", "path"),
    ("typescript", "nest.Post", "both", "Post@Controller", "http.endpoint", "inbound", "http", "path"),
    ("typescript", "nest.Put", "both", "Put@Controller", "http.endpoint", "inbound", "http", "path"),
    ("typescript", "nest.Delete", "both", "Delete@Controller", "http.endpoint", "inbound", "http", "path"),
    ("typescript", "nest.MessagePattern", "annotation", "MessagePattern", "mq.listener", "inbound", "nest", "cmd"),
    ("typescript", "nest.EventPattern", "annotation", "EventPattern", "mq.listener", "inbound", "nest", "cmd"),
    ("typescript", "ts.fetch", "call", ".fetch", "http.client", "outbound", "http", "call"),
    ("typescript", "ts.axios", "call", "axios.*", "http.client", "outbound", "http", "call"),
    ("rust", "actix.get", "annotation", "get", "http.endpoint", "inbound", "http", "path"),
    ("rust", "actix.post", "annotation", "post", "http.endpoint", "inbound", "http", "path"),
    ("rust", "actix.put", "annotation", "put", "http.endpoint", "inbound", "http", "path"),
    ("rust", "actix.delete", "annotation", "delete", "http.endpoint", "inbound", "http", "path"),
    ("rust", "axum.route", "call", "Router.route", "http.endpoint", "inbound", "http", "call"),
    ("rust", "rust.main", "entry", "main", "cli.command", "inbound", "cli", ""),
    ("rust", "clap.command", "annotation", "command", "cli.command", "inbound", "cli", "name"),
    ("rust", "reqwest.Client", "call", "Client.*", "http.client", "outbound", "http", ""),
)
MOST_BOUNDARIES = 12


def _simple(name: Column) -> Column:
    """A type name without generics and qualifiers."""
    return F.regexp_extract(F.regexp_replace(name, "<.*$", ""), r"([^.:]*)$", 1)


def _named(pattern: str):
    """Annotations of that name; ``*.suffix`` for any receiver."""
    return lambda a: a["name"].endswith(pattern[1:]) if pattern.startswith("*.") else a["name"] == pattern


def _is_type(name: str):
    return lambda t: _simple(t) == name


def _calls(owner: str, name: str):
    """Calls of ``owner.name``; no owner means calls without a receiver, ``*`` any member."""
    return lambda x: ((_simple(x["owner"]) == owner) if owner else x["owner"].isNull()) & ((x["name"] == name) if name != "*" else F.lit(True))


def boundaries(symbols: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(id, kind, direction, protocol, detail, source), at most 12 a symbol in the order of the rules.

    symbols: id, language, kind, name, owner, route, annotations array<struct<name,args>>, supertypes array<string>,
    calls array<struct<name,owner,arg>>. owners: (owner, annotations) of the declaring types.
    """
    # the others have nothing that a rule looks at
    entries = [what for _, _, how, what, *_ in BOUNDARY_RULES if how == "entry"]
    s = symbols.where(c("route").isNotNull() | c("name").isin(entries) | F.coalesce(reduce(F.greatest, (F.coalesce(F.size(x), F.lit(-1)) for x in ("annotations", "supertypes", "calls"))) > 0, F.lit(False)))
    if owners is not None:
        s = s.join(owners.select("owner", c("annotations").alias("owner_annotations")), "owner", "left")
    else:
        s = s.withColumn("owner_annotations", F.lit(None).cast("array<struct<name:string,args:string>>"))
    found = []
    for lang, rule, how, what, kind, direction, protocol, detail in BOUNDARY_RULES:
        if how == "route":
            hit, text = c("route").isNotNull(), c("route")
        elif how in ("annotation", "both"):
            own = what.split("@")[0]
            matched = F.filter("annotations", _named(own))
            hit = F.size(matched) > 0
            if how == "both":
                hit = hit & F.coalesce(F.exists("owner_annotations", _named(what.split("@")[1])), F.lit(False))
            args = F.get(matched, 0)["args"]
            named = [F.nullif(F.regexp_extract(args, rf"\b{n}\s*[=:]\s*[\"'`]([^\"'`]*)[\"'`]", 1), F.lit("")) for n in detail.split()]
            text = F.coalesce(*named, F.nullif(F.regexp_extract(args, "[\"'`]([^\"'`]*)[\"'`]", 1), F.lit(""))) if detail else F.lit(None)
        elif how == "supertype":
            hit, text = F.exists("supertypes", _is_type(what)), F.lit(None)
        elif how == "entry":
            hit, text = (c("name") == what) & (c("owner").isNull() | (c("language") == "java")), F.lit(None)
        else:
            owner, name = what.rsplit(".", 1)
            matched = F.filter("calls", _calls(owner, name))
            hit, text = F.size(matched) > 0, F.get(matched, 0)["arg"] if detail == "call" else F.lit(None)
        tag = F.struct(F.lit(kind).alias("kind"), F.lit(direction).alias("direction"), F.lit(protocol).alias("protocol"), text.cast("string").alias("detail"), F.lit(rule).alias("source"))
        found.append(F.when((c("language") == lang) & F.coalesce(hit, F.lit(False)), tag))
    every = F.slice(F.array_distinct(F.filter(F.array(*found), lambda t: t.isNotNull())), 1, MOST_BOUNDARIES)
    return s.select("id", F.explode(every).alias("b")).select("id", "b.*")
