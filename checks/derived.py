"""Corpora derived from the given tables, once as DataFrames and once as SQL text.

The tables hold no source code, so every order becomes one line of a virtual source file:
64 orders make a file, and the file number picks its language. The line is a template of the
language with the order key filled in. Nothing is filtered out, so the corpus grows with the
table. The SQL twins below build the same rows for the comparison engine.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftguard.session import dimension

LINES_PER_FILE = 64

# language → (path pattern with the file number as <f>, line templates with the key as <n>)
LANGUAGES: dict[str, tuple[str, list[str]]] = {
    "py_db": ("src/m<g>/db<f>.py", [
        "import sqlite3",
        "cur.execute(f\"SELECT * FROM t WHERE id = {<n>}\")",
        "cur.execute('SELECT * FROM t WHERE id = <n>')",
        "cur.execute(\"SELECT * FROM t WHERE id = \" + k<n>)",
        "cur.execute(\"SELECT a FROM t WHERE id = %s\" % key<n>)",
        "q<n> = \"DELETE FROM t WHERE id = {}\".format(key)",
        "rows = Model.objects.raw(f\"SELECT <n>\")",
        "rows = Model.objects.raw(\"SELECT <n>\")",
        "cur.executemany('INSERT INTO t VALUES (?)', rows<n>)",
    ]),
    "py_exec": ("src/m<g>/run<f>.py", [
        "import os, pickle",
        "os.system(\"ls \" + arg<n>)",
        "os.system(\"ls\")  # nosec",
        "subprocess.run(cmd<n>, shell=True)",
        "subprocess.run([cmd<n>], shell=False)",
        "val = eval(expr<n>)",
        "val = eval(\"<n>\")",
        "exec( code<n> )  # nosec: Code Injection",
        "exec('x = <n>')",
        "from marshal import loads",
        "assert user<n>.is_admin",
        "assert x<n> > 0",
    ]),
    "py_io": ("src/m<g>/io<f>.py", [
        "import telnetlib",
        "p<n> = os.path.join(base, filename)",
        "p<n> = os.path.join(base, 'fixed')",
        "r<n> = send_file(root + request.args['f'])",
        "full = UPLOAD_DIR + filename",
        "rel<n> = '../data/<n>'",
        "obj = pickle.loads(blob<n>)",
        "obj = pickle.load(fh<n>)",
        "obj = marshal.loads(blob<n>)",
        "db<n> = shelve.open('s<n>')",
        "cfg = yaml.load(fh<n>)",
        "cfg = yaml.load(fh<n>, Loader=yaml.SafeLoader)",
        "obj = jsonpickle.decode(text<n>)",
        "html = mark_safe(text<n>)",
        "tpl<n> = '{{ body|safe }}'",
    ]),
    "py_crypto": ("src/m<g>/sec<f>.py", [
        "import ftplib",
        "h = hashlib.md5(b<n>)",
        "h = hashlib.sha1(b<n>)  # noqa: E501",
        "h = hashlib.sha256(b<n>)",
        "c = DES.new(key<n>, 1)",
        "c = AES.new(key<n>, AES.MODE_ECB)",
        "k = rsa.generate_private_key(65537, <n>)",
        "t<n> = random.randint(0, <n>)",
        "requests.get(u<n>, verify=False)  # nosec",
        "requests.get(u<n>, verify=False)",
        "iv = b\"1234567890abcdef\"",
        "iv = os.urandom(16)",
        "print(\"password\", password<n>)",
        "print(\"count\", n<n>)",
    ]),
    "py_web": ("src/m<g>/web<f>.py", [
        "import cgi",
        "DEBUG = True  # noqa: debug",
        "DEBUG = True",
        "DEBUG = <n>",
        "app.run(host=h<n>, debug=True)",
        "ALLOWED_HOSTS = []",
        "ALLOWED_HOSTS = ['h<n>']",
        "SECRET_KEY = 'changeme'",
        "SECRET_KEY = 'k-<n>-K'",
        "out = jsonify(os.environ)",
        "sock.bind(('0.0.0.0', <n>))",
        "x<n> = <n>  # siftguard: ignore",
        "log.info(f\"token {token<n>}\")  # siftguard: ignore Logging, other",
    ]),
    "py_broken": ("src/m<g>/bad<f>.py", [
        "def broken<n>(:",
        "val = eval(expr<n>)",
        "import pickle",
    ]),
    "js": ("web/m<g>/a<f>.js", [
        "el.innerHTML = v<n>;",
        "el.innerHTML=\"v<n>\";",
        "el.innerHTML = v<n>;  // nosec: XSS",
        "document.write(v<n>);",
        "document.write('v<n>');",
        "child_process.exec(c<n>);",
        "var f = new Function(b<n>);",
        "const s = require('node-serialize');",
        "console.log(\"pin\", pin<n>);",
        "db.execute(\"SELECT * FROM t WHERE id = \" + <n>);",
    ]),
    "jsx": ("web/m<g>/v<f>.jsx", [
        "<p dangerouslySetInnerHTML={{__html: m<n>}} />",
        "<p>{m<n>}</p>",
        "node.innerHTML=m<n>",
    ]),
    "php": ("php/m<g>/p<f>.php", [
        "echo \"x\" . $_GET['k<n>'];",
        "echo htmlspecialchars($k<n>);",
        "system($c<n>);",
        "$o = unserialize($b<n>);",
        "$r = mysql_raw(\"SELECT a FROM t WHERE k=\" . <n>);",
    ]),
    "java": ("java/m<g>/C<f>.java", [
        "Object o = new ObjectInputStream(s<n>);",
        "int x<n> = <n>;",
        "log.info(\"ssn \" + ssn);  // noqa",
        "String p = \"../etc/<n>\";",
    ]),
    "docker": ("deploy/m<g>/d<f>/Dockerfile", [
        "FROM python:latest",
        "FROM python:3.<n>",
        "USER root",
        "USER app<n>",
        "ADD https://host/<n>.tgz /opt",
        "ENV DB_PASSWORD=p<n>",
        "EXPOSE 22",
        "EXPOSE 8080",
        "RUN curl https://host/<n> | sh",
    ]),
    "compose": ("deploy/m<g>/c<f>/docker-compose.yml", [
        "services:",
        "    privileged: true",
        "    network_mode: \"host\"",
        "    pid: host",
        "    image: app:<n>",
    ]),
    "stack": ("deploy/m<g>/s<f>.yaml", [
        "version: '3'",
        "services:",
        "    privileged: true  # nosec",
        "    pid: 'host'",
        "    image: app:<n>",
    ]),
    "k8s": ("deploy/m<g>/k<f>.yaml", [
        "apiVersion: v1",
        "kind: Pod",
        "    privileged: true",
        "    runAsUser: 0",
        "    runAsUser: 10<n>",
        "    hostNetwork: true",
        "    hostPID: true",
        "    allowPrivilegeEscalation: true",
        "    readOnlyRootFilesystem: false",
        "    image: app:<n>",
    ]),
    "tf": ("deploy/m<g>/t<f>.tf", [
        "cidr_blocks = [\"0.0.0.0/0\"]",
        "cidr_blocks = [\"10.0.0.0/8\"]",
        "acl = \"public-read\"",
        "encrypted = false",
        "publicly_accessible = true",
        "name = \"r<n>\"",
    ]),
    "plain_yaml": ("conf/m<g>/y<f>.yml", [
        "key<n>: value",
        "privileged: true",
    ]),
}


def _templates() -> list[dict]:
    return [{"lang": i, "pattern": pattern, "idx": j, "size": len(lines), "template": text}
            for i, (pattern, lines) in enumerate(LANGUAGES.values()) for j, text in enumerate(lines)]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered_lines(keys: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """(path, line, text) for each key; one small join with the templates, no shuffle."""
    n = F.col(key)
    file_no = F.shiftright(n, LINES_PER_FILE.bit_length() - 1)
    rows = _templates()
    schema = StructType.fromDDL("lang int, pattern string, idx int, size int, template string")
    templates = dimension(keys.sparkSession, rows, schema)
    sizes = [len(lines) for _, lines in LANGUAGES.values()]
    lang = F.pmod(file_no, F.lit(len(LANGUAGES)))
    offset = F.pmod(n, F.lit(LINES_PER_FILE))
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), (lang + 1).cast("int"))
    base = keys.select(*keep, n.alias("n"), file_no.alias("f"), lang.cast("int").alias("lang"),
                       offset.alias("offset"), F.pmod(offset, size).cast("int").alias("idx"))
    path = F.replace(F.replace("pattern", F.lit("<f>"), F.col("f").cast("string")), F.lit("<g>"),
                     F.pmod("f", F.lit(97)).cast("string"))
    return base.join(templates, ["lang", "idx"]).select(
        *keep, path.alias("path"), (F.col("offset") + 1).cast("int").alias("line"),
        F.replace("template", F.lit("<n>"), F.col("n").cast("string")).alias("text"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code corpus as whole files; each group holds one file of at most 64 lines."""
    return files_of(numbered_lines(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"))


def files_of(lines: DataFrame) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("line", "text")))
    content = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    grouped = lines.groupBy("path").agg(content.alias("content"))
    return grouped.select("path", F.octet_length("content").cast("bigint").alias("length"), "content",
                          F.lit(None).cast("string").alias("skip_reason"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values() -> str:
    rows = ", ".join(f"({r['lang']}, {_quote(r['pattern'])}, {r['idx']}, {r['size']}, {_quote(r['template'])})"
                     for r in _templates())
    return f"(VALUES {rows}) AS t(lang, pattern, idx, size, template)"


def lines_sql(source: str = "orders", key: str = "o_orderkey") -> str:
    """SQL twin of :func:`numbered_lines`."""
    return f"""
    SELECT replace(replace(t.pattern, '<f>', CAST({key} // {LINES_PER_FILE} AS VARCHAR)),
                   '<g>', CAST(({key} // {LINES_PER_FILE}) % 97 AS VARCHAR)) AS path,
           CAST({key} % {LINES_PER_FILE} + 1 AS INTEGER) AS line,
           replace(t.template, '<n>', CAST({key} AS VARCHAR)) AS text
    FROM {source} JOIN {_values()}
      ON t.lang = ({key} // {LINES_PER_FILE}) % {len(LANGUAGES)}
     AND t.idx = ({key} % {LINES_PER_FILE}) % t.size"""


FILES_SQL = "SELECT path, string_agg(text, chr(10) ORDER BY line) AS content FROM lines GROUP BY path"


def local_path(uri: str) -> str:
    """A folder of the shared file system as programs see it."""
    return uri.removeprefix("file://")


def write_tree(rows: DataFrame, root: str) -> int:
    """Write (path, text) rows as files below ``root``, by tasks; returns how many."""
    def write(batches):
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                place = Path(root, path)
                place.parent.mkdir(parents=True, exist_ok=True)
                # A task may run twice; the file is complete either time.
                part = place.with_name(f".{place.name}-{uuid.uuid4().hex}")
                part.write_bytes(text.encode())
                os.replace(part, place)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.where("text is not null").mapInPandas(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
