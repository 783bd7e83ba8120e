"""Facts from other files than sources: build modules, API specifications, class files and commits."""

from __future__ import annotations

import json
import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.resolvers.base import Facts, class_id, edges, nodes, unite

# Names that generated proxies bear.
CGLIB, FACTORY, JDK = "CGLIB", "org/springframework/cglib/proxy/Factory", "$Proxy"
VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def modules(files: DataFrame, root: str) -> Facts:
    """Maven and Gradle modules under a root, and which of them depend on each other.

    files has file and text. A root POM with modules names their folders; one without is a module
    itself; else the include lines of a Gradle settings file name them.
    """
    root = root.rstrip("/")
    place = F.regexp_replace(F.regexp_replace("file", "^file:/+", "/"), "/[^/]*$", "")
    named = files.select(place.alias("folder"), F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "text")
    poms = named.where("name = 'pom.xml'")
    bare = F.regexp_replace("text", r"(?s)<!--.*?-->|<parent>.*?</parent>", "")
    own = F.regexp_replace(bare, r"(?s)<(dependencies|dependencyManagement|build|profiles)>.*?</\1>", "")
    tag = lambda text, name: F.nullif(F.trim(F.regexp_extract(text, rf"<{name}>\s*([^<]*?)\s*</{name}>", 1)), F.lit(""))
    above = F.regexp_extract("text", r"(?s)<parent>(.*?)</parent>", 1)
    read = poms.select(
        "folder", F.coalesce(tag(own, "artifactId"), tag(bare, "artifactId")).alias("artifact"),
        F.coalesce(tag(own, "groupId"), tag(above, "groupId")).alias("group"), F.coalesce(tag(own, "version"), tag(above, "version"), F.lit("0.1.0")).alias("version"),
        F.regexp_extract_all(F.regexp_extract(bare, r"(?s)<modules>(.*?)</modules>", 1), F.lit(r"<module>\s*([^<]*?)\s*</module>"), 1).alias("parts"),
        F.transform(F.regexp_extract_all(bare, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1), lambda d: F.regexp_extract(d, r"<artifactId>\s*([^<]*?)\s*</artifactId>", 1)).alias("needs"),
    )
    top = read.where(F.col("folder") == root)
    wanted = top.select(F.explode("parts").alias("part")).select(F.concat(F.lit(root + "/"), "part").alias("folder"))
    maven = unite(read.join(wanted, "folder", "left_semi").select(*read.columns), top.where(F.size("parts") == 0)).select("artifact", "group", "version", "needs")
    include = F.regexp_extract_all("text", F.lit(r"(?m)^\s*include\b([^\n]*)"), 1)
    gradle = named.where(F.col("name").isin("settings.gradle", "settings.gradle.kts") & (F.col("folder") == root)).select(F.explode(F.flatten(F.transform(include, lambda x: F.split(F.regexp_replace(x, r"[()'\"\s]", ""), ",")))).alias("a"))
    gradle = gradle.select(F.replace(F.regexp_replace("a", "^:", ""), F.lit(":"), F.lit("/")).alias("artifact")).where("artifact <> ''").distinct()
    gradle = gradle.join(top.select("folder").limit(1), F.lit(True), "left_anti")
    every = unite(maven, gradle.select("artifact", F.col("artifact").alias("group"), F.lit("0.1.0").alias("version"), F.array().cast("array<string>").alias("needs")))
    node = F.concat(F.lit("module:"), "artifact")
    made = nodes(every, node, F.col("artifact"), "MODULE", 0, artifactId=F.col("artifact"), groupId=F.coalesce("group", "artifact"), version=F.col("version"))
    needs = every.select("artifact", F.explode("needs").alias("need")).join(every.select(F.col("artifact").alias("need")), "need", "left_semi")
    return Facts(made, edges(needs, node, F.concat(F.lit("module:"), "need"), "DEPENDS_ON").distinct())


def _paths(text: str | None) -> str:
    """JSON list of (path, verb) of a specification in JSON, or in YAML with a block for each path and verb."""
    text = text or ""
    if text.lstrip().startswith("{"):
        try:
            found = json.loads(text).get("paths") or {}
        except ValueError:
            return "[]"
        return json.dumps([{"path": p, "verb": v} for p, verbs in found.items() for v in verbs or {} if v.lower() in VERBS])
    out, inside, path, depth = [], False, "", 0
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        key = re.match(r"""(['"]?)(.+?)\1\s*:(\s|$)""", bare)
        if indent == 0:
            inside = bool(key) and key[2] == "paths"
        elif inside and key:
            if key[2].startswith("/"):
                path, depth = key[2], indent
            elif path and indent > depth and key[2].lower() in VERBS:
                out.append({"path": path, "verb": key[2]})
    return json.dumps(out)


@F.pandas_udf(T.StringType())
def _spec(texts: pd.Series) -> pd.Series:
    return pd.Series([_paths(t) for t in texts], dtype=object)


def specification(files: DataFrame) -> DataFrame:
    """(path, verb) of the first specification: openapi.yaml, openapi.json, then swagger.yaml."""
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    rank = F.when(name == "openapi.yaml", 0).when(name == "openapi.json", 1).when(name == "swagger.yaml", 2)
    first = files.where(rank.isNotNull()).orderBy(rank, "file").limit(1)
    return first.select(F.inline(F.from_json(_spec("text"), "array<struct<path:string,verb:string>>"))).distinct()


def _class_head(content: bytes) -> dict | None:
    """Name, super-class and interfaces from a class file's constant pool and header."""
    try:
        if content[:4] != b"\xca\xfe\xba\xbe":
            return None
        count, at, pool, n = struct.unpack_from(">H", content, 8)[0], 10, {}, 1
        sizes = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
        while n < count:
            kind = content[at]
            if kind == 1:
                size = struct.unpack_from(">H", content, at + 1)[0]
                pool[n] = content[at + 3 : at + 3 + size].decode("utf-8", "replace")
                at += 3 + size
            else:
                pool[n] = struct.unpack_from(">H", content, at + 1)[0]
                at += 1 + sizes[kind]
            n += 2 if kind in (5, 6) else 1
        _, own, above, faces = struct.unpack_from(">HHHH", content, at)
        called = lambda i: pool[pool[i]] if i else None
        interfaces = [called(i) for i in struct.unpack_from(f">{faces}H", content, at + 8)]
        return {"name": called(own), "super": called(above), "interfaces": interfaces}
    except (struct.error, IndexError, KeyError):
        return None


@F.pandas_udf(T.StringType())
def _heads(contents: pd.Series) -> pd.Series:
    return pd.Series([None if (h := _class_head(bytes(c or b""))) is None else json.dumps(h) for c in contents], dtype=object)


def class_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, name, super, interfaces) of the class files under a root."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.class").load(root)
    head = F.from_json(_heads("content"), "name string, super string, interfaces array<string>")
    return rows.select(F.col("path").alias("file"), head.alias("h")).where("h is not null").select("file", "h.*")


def generated_proxies(heads: DataFrame) -> Facts:
    """Proxies among class files (class_files) and the classes that they stand for."""
    cglib = F.col("name").contains("$$") & F.col("name").contains(CGLIB) | F.array_contains("interfaces", FACTORY)
    kind = F.when(cglib & ~F.col("name").contains(JDK) | F.col("name").contains("$$"), F.when(cglib, "cglib")).when(F.col("name").contains(JDK), "jdk").when(cglib, "cglib")
    other = F.filter("interfaces", lambda i: ~i.rlike("^(java|jdk)/"))
    target = F.when(F.col("proxy") == "cglib", F.nullif("super", F.lit("java/lang/Object"))).otherwise(F.coalesce(F.get(other, F.lit(0)), F.get("interfaces", F.lit(0))))
    dots = lambda c: F.translate(c, "/", ".")
    rows = heads.withColumn("proxy", kind).where("proxy is not null").withColumn("to", dots(target)).where("`to` is not null").withColumn("name", dots("name"))
    node = F.concat(F.lit("proxy:"), "name")
    made = nodes(rows, node, F.col("name"), "PROXY", 2, proxyType=F.col("proxy"), targetClass=F.col("to"), classFile=F.col("file"))
    # a class that nothing else names; the fold keeps what an earlier fact says
    targets = nodes(rows, class_id("to"), F.col("to"), "SERVICE", 2)
    return Facts(unite(made, targets), edges(rows, node, class_id("to"), "CALLS").distinct())


def commits(headers: DataFrame) -> DataFrame:
    """(hash, message, author_name, author_email, at, signature, key) of raw commits (hash, raw).

    raw is a commit as `git cat-file -p` prints it. A signature header is SSH or GPG by its armour; of
    an SSH signature the first line of its body stands for the key.
    """
    head, message = F.substring_index("raw", "\n\n", 1), F.regexp_extract("raw", r"(?s)\n\n(.*)$", 1)
    author = r"(?m)^author (.*?) <([^>]*)> (\d+)"
    signed = F.regexp_extract(head, r"(?sm)^gpgsig(?:-sha256)? (.*)", 1)
    kind = F.when(signed.contains("BEGIN SSH SIGNATURE"), "SSH").when(signed.contains("BEGIN PGP"), "GPG")
    key = F.regexp_extract(signed, r"BEGIN SSH SIGNATURE-----\s+(\S+)", 1)
    return headers.select(
        "hash", F.substring_index(message, "\n", 1).alias("message"), F.regexp_extract(head, author, 1).alias("author_name"),
        F.regexp_extract(head, author, 2).alias("author_email"), F.timestamp_seconds(F.regexp_extract(head, author, 3).try_cast("long")).alias("at"),
        kind.alias("signature"), F.when(kind == "SSH", key).alias("key"),
    )




def commit_log(text: DataFrame) -> DataFrame:
    """(hash, raw) of logs as `git log --format=raw` prints them (column text), for commits()."""
    parts = text.select(F.explode(F.split("text", r"(?m)^(?=commit [0-9a-f]{40})")).alias("p")).where(F.col("p").startswith("commit "))
    rest = F.regexp_replace(F.regexp_replace("p", r"^commit [^\n]*\n", ""), r"(?m)^    ", "")
    return parts.select(F.regexp_extract("p", "^commit ([0-9a-f]{40})", 1).alias("hash"), rest.alias("raw"))
