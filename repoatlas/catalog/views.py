"""Input views of the registered queries, derived from the given tables.

A corpus of repositories is made of `documents`: every document becomes one file, its path
and the first lines of its content follow from its id, the rest is its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GRADLE = """plugins {
    id 'java'
    id 'org.springframework.boot' version '3.2.0'
}
dependencies {
    implementation 'org.springframework.boot:spring-boot-starter-web:3.2.0'
    testImplementation "junit:junit:4.13.2"
    runtimeOnly(group: 'org.postgresql', name: 'postgresql', version: '42.7.1')
}
task copyDocs(type: Copy) { }
application { mainClass = 'com.acme.Application' }
"""

# paths for a Java, a Python and a JavaScript repo, and the first lines of the content
TEMPLATES: list[tuple[tuple[str, str, str], str]] = [
    (
        ("src/main/java/com/acme/Application.java", "app.py", "index.js"),
        "@SpringBootApplication\npublic class Application {\n"
        "    public static void main(String[] args) { }\n}\n",
    ),
    (("build.gradle", "pyproject.toml", "package.json"), _GRADLE),
    (("README.md",) * 3, "# svc\n\n\n\nTODO: Write a meaningful README\n"),
    (("application.yml",) * 3, "server:\n  port: 8080\n"),
    (("start-local.sh",) * 3, "#!/bin/sh\n./gradlew run\n"),
    (
        (
            "src/main/java/com/acme/OrderController.java",
            "src/order_controller.py",
            "src/order_controller.js",
        ),
        '@RestController\nclass OrderController {\n    @GetMapping("/orders")\n'
        '    @PostMapping("/orders")\n}\n',
    ),
    (
        (
            "src/main/java/com/acme/OrderService.java",
            "src/order_service.py",
            "src/order_service.js",
        ),
        "@Service class OrderService { }\n",
    ),
    (("application-env-local.yml.example",) * 3, "db:\n  password: CHANGE_ME\n"),
    (("docker-compose.yml",) * 3, "services:\n"),
    (
        ("pom.xml", "requirements.txt", "tsconfig.json"),
        "<dependency>\n  <groupId> org.acme </groupId>\n  <artifactId>lib</artifactId>\n"
        "  <version>1.0</version>\n</dependency>\n",
    ),
    (("src/build/Generated.java",) * 3, ""),
    (("sonar-project.properties",) * 3, ""),
    (("scripts/stop.sh",) * 3, ""),
    (("sub module/build.gradle",) * 3, "apply plugin: 'application'\n" + _GRADLE),
    (("web/helper.ts",) * 3, ""),
    (("docs/readme.md",) * 3, ""),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, repo, path, size, content``."""
    k, v = F.expr("(doc_id div 20) % 16"), F.expr("(doc_id % 20) % 3")
    paths = F.array(*[F.lit(p) for variants, _ in TEMPLATES for p in variants])
    prefixes = F.array(*[F.lit(prefix) for _, prefix in TEMPLATES])
    return (
        table(spark, sf_dir, "documents")
        .select(
            "doc_id",
            F.concat("source", F.lit("_"), F.expr("doc_id div 320").cast("string")).alias("repo"),
            F.get(paths, (k * 3 + v).cast("int")).alias("path"),
            F.concat(F.get(prefixes, k.cast("int")), "text").alias("content"),
        )
        .select(
            "doc_id", "repo", "path",
            F.octet_length("content").cast("bigint").alias("size"), "content",
        )
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_with_id(spark, sf_dir).drop("doc_id")


def step_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, step, output``: a conversation is a repo, a turn is a step."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("repo"),
        (F.col("turn") + 1).cast("int").alias("step"),
        F.col("text").alias("output"),
    )


def fenced_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, text``, with a fence around two of three conversations."""
    kind = F.col("conv_id") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("```markdown\n"), "text", F.lit("\n```\nbye")))
        .when(kind == 1, F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def corpus_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, step, output`` for the repos of `files`."""
    conv = F.col("conv_id")
    return fenced_conversations(spark, sf_dir).select(
        F.concat(
            F.lit("src"), (conv % 20).cast("string"), F.lit("_"),
            F.expr("conv_id div 20").cast("string"),
        ).alias("repo"),
        (F.col("turn") + 1).cast("int").alias("step"),
        F.col("text").alias("output"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, output``: a verdict on the README of each repo with a label."""
    readmes = files_with_id(spark, sf_dir).filter(F.col("path") == "README.md")
    answer = F.when(F.col("quality") == 1, F.lit("Specific enough.\nNO")).otherwise(
        F.lit("Mostly template text.\nYES")
    )
    return readmes.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "repo", answer.alias("output")
    )


def api_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, type, method, endpoint, name, repository, ord`` from the addresses of pages."""
    number, none = F.col("page_id"), F.lit(None).cast("string")
    kind = number % 4
    return table(spark, sf_dir, "pages").select(
        F.concat(
            F.lit("src"), (number % 20).cast("string"), F.lit("_"),
            F.expr("(page_id div 20) % 4").cast("string"),
        ).alias("repo"),
        F.when(kind == 3, none).when(number % 3 == 0, F.lit("Page")).otherwise(F.lit("Api")).alias("type"),
        F.when(kind == 0, F.lit("GET")).otherwise(none).alias("method"),
        F.when(kind == 0, F.col("url")).otherwise(none).alias("endpoint"),
        F.when(kind == 1, F.col("url")).otherwise(none).alias("name"),
        F.when(kind >= 2, F.col("url")).otherwise(none).alias("repository"),
        F.lpad(number.cast("string"), 12, "0").alias("ord"),
    )


def step_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template files of a prompt collection per repo: ``repo, path, size, content``."""
    k = F.expr("(doc_id div 20) % 16")
    name = F.concat(
        F.lpad((k % 6).cast("string"), 2, "0"), F.lit("-step"), k.cast("string"),
        F.when(k % 5 == 4, F.lit(".SKIP")).otherwise(F.lit("")),
        F.when(k % 7 == 6, F.lit(".txt")).otherwise(F.lit(".md")),
    )
    return files_with_id(spark, sf_dir).select(
        "repo", F.concat(F.lit("prompts/default/"), name).alias("path"), "size", "content"
    )
