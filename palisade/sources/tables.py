"""Base tables and the adapter views that give them an application's shape.

Views over one table are lists of expressions that Spark SQL and DuckDB both
accept, so that a query and its oracle start from the same definition.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

TEXT_HEAVY = {"documents", "pages", "conversations"}

# Quote characters are spelled chr(34)/chr(39) and line breaks chr(10): both engines agree on those.
Q = "chr(34)"
A = "chr(39)"
NL = "chr(10)"



def text_sql(template: str, **columns: str) -> str:
    """SQL for a text: ``<name>`` stands for a column's expression, quotes and line breaks are spelled out."""
    out = []
    for piece in re.split(r"(<[a-z]+>|[\n\"'])", template):
        if piece in ("\n", '"', "'"):
            out.append({"\n": NL, '"': Q, "'": A}[piece])
        elif re.fullmatch("<[a-z]+>", piece):
            out.append(columns[piece[1:-1]])
        elif piece:
            out.append(f"'{piece}'")
    return " || ".join(out)


# A description a page, in two spellings with the same content; pages differ in what they declare.
_PAGE = {
    "id": "CAST(page_id AS STRING)", "server": "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)", "low": "CAST(page_id % 7 AS STRING)",
    "secure": "CASE WHEN page_id % 4 = 0 THEN {} ELSE '' END", "refuse": "CASE WHEN page_id % 3 = 0 THEN {} ELSE '' END",
}
_YAML = """# made from a page
openapi: 3.0.3   # version
info:
  title: 'It''s <id>'
  description: >-
    paths: are not
    declared here
servers:
- url: <server>
  description: |
    - url: http://nowhere
<secure>paths:
  /api/items<id>/{id}:
    get:
      summary: Read item
        <id>
      parameters:
        - name: q
          in: query
          required: true
          schema: {type: string, enum: [a, "b c", 'd']}
        -
          name: "limit"   # of rows
          in: query
          schema:
            type: integer
            minimum: <low>
      responses:
        '200':
          description: "found,
            whole"
          content:
            application/json:
              schema: {$ref: '#/components/schemas/Page'}
<refuse>    put:
      requestBody:
        content:
          application/json:
            schema:
              type: object
              required:
              - name
              properties:
                name: {type: string, maxLength: 80,
                  minLength: 1}
                tags:
                  type: array
                  minItems: <low>
                  items:
                    $ref: '#/components/schemas/Owner'
      responses: {'204': {description: done}}
components:
  schemas:
    Page:
      type: object
      required: [id, "title"]
      properties:
        id: {type: integer, minimum: 1}
        title:
          type: string
        owner:
          $ref: '#/components/schemas/Owner'

    Owner:
      type: object
      properties:
        email:
          type: string
          format: email
"""
_JSON = (
    '{"openapi":"3.0.3","servers":[{"url":"<server>"}],<secure>"paths":{"/api/items<id>/{id}":{"get":{"summary":"Read item <id>","parameters":['
    '{"name":"q","in":"query","required":true,"schema":{"type":"string","enum":["a","b c","d"]}},{"name":"limit","in":"query","schema":{"type":"integer","minimum":<low>}}],'
    '"responses":{"200":{"description":"found, whole","content":{"application/json":{"schema":{"$ref":"#/components/schemas/Page"}}}}<refuse>}},'
    '"put":{"requestBody":{"content":{"application/json":{"schema":{"type":"object","required":["name"],"properties":{"name":{"type":"string","maxLength":80,"minLength":1},'
    '"tags":{"type":"array","minItems":<low>,"items":{"$ref":"#/components/schemas/Owner"}}}}}}},"responses":{"204":{"description":"done"}}}}},'
    '"components":{"schemas":{"Page":{"type":"object","required":["id","title"],"properties":{"id":{"type":"integer","minimum":1},"title":{"type":"string"},"owner":{"$ref":"#/components/schemas/Owner"}}},'
    '"Owner":{"type":"object","properties":{"email":{"type":"string","format":"email"}}}}}}'
)


def _page_text(template: str, secure: str, refuse: str) -> str:
    return text_sql(template, **{**_PAGE, "secure": _PAGE["secure"].format(text_sql(secure)), "refuse": _PAGE["refuse"].format(text_sql(refuse))})


VIEWS: dict[str, tuple[str, list[str]]] = {
    "users": (
        "customer",
        [
            "c_custkey AS id",
            "c_name AS name",
            "lower(replace(c_name, '#', '.')) || '@example.com' AS email",
            "CASE WHEN c_nationkey = 0 THEN 'admin' ELSE 'user' END AS role",
        ],
    ),
    "products": (
        "part",
        [
            "p_partkey AS id",
            "p_name AS name",
            "p_type || ' ' || p_brand AS description",
            "p_retailprice AS price",
            "p_partkey % 25 AS category_id",
            "p_size AS stock",
            "p_size > 25 AS active",
        ],
    ),
    "order_items": (
        "lineitem",
        [
            "l_orderkey AS order_id",
            "l_linenumber AS id",
            "l_partkey AS product_id",
            "l_quantity AS quantity",
            "l_extendedprice / l_quantity AS price",
        ],
    ),
    "orders_e": (
        "orders",
        [
            "o_orderkey AS id",
            "o_custkey AS user_id",
            "o_totalprice AS total_amount",
            "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' ELSE 'delivered' END AS status",
            "o_orderdate AS created_at",
        ],
    ),
    "files": ("documents", ["source AS repo", "CAST(doc_id AS STRING) || '.txt' AS path", "text AS content"]),
    "web_files": ("pages", ["regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS repo", "CAST(page_id AS STRING) || '.html' AS path", "html AS content"]),
    "requests": (
        "events",
        [
            "event_id AS req_id",
            "event_id AS seq",
            "ts",
            "user_id",
            "CASE event_type WHEN 'signup' THEN 'POST' WHEN 'click' THEN 'PUT' WHEN 'error' THEN 'DELETE' "
            "ELSE 'GET' END AS method",
            "CASE WHEN value < 1 THEN 'abc' ELSE CAST(user_id * 11 AS STRING) END AS raw_id",
            "props AS body",
        ],
    ),
    # Query strings of a request log: every event type carries its own kind of payload.
    "payloads": (
        "events",
        [
            "event_id AS req_id",
            "user_id",
            "CASE WHEN event_type = 'error' AND value < 40 THEN 'id=' || CAST(user_id AS STRING) || "
            "'%20AND%20' || CAST(event_id AS STRING) || '=' || CAST(event_id AS STRING) "
            "WHEN event_type = 'error' THEN 'id=' || CAST(user_id AS STRING) || ' AND ' || "
            "CAST(event_id AS STRING) || '=' || CAST(user_id AS STRING) "
            "WHEN event_type = 'signup' AND value < 40 THEN 'q=test' || chr(39) || "
            "' UNION ALL SELECT CHAR(113,112),NULL-- ' || CAST(event_id AS STRING) "
            "WHEN event_type = 'signup' THEN 'id=' || CAST(user_id AS STRING) || "
            "' AND 1=LIKE(CHAR(65,66),UPPER(HEX(RANDOMBLOB(' || CAST(event_id AS STRING) || '))))' "
            "WHEN event_type = 'click' AND value < 40 THEN 'file=..%2F..%2Fetc%2Fpasswd&u=' || CAST(user_id AS STRING) "
            "WHEN event_type = 'click' THEN 'u=' || CAST(user_id AS STRING) || '&u=' || CAST(event_id AS STRING) "
            "WHEN event_type = 'purchase' AND value < 20 THEN 'url=http://169.254.169.254/' || CAST(user_id AS STRING) "
            "WHEN event_type = 'purchase' AND value < 40 THEN 'name=o' || chr(39) || 'x&u=' || CAST(user_id AS STRING) "
            "ELSE 'page=' || CAST(user_id AS STRING) || '&k=' || props END AS query",
        ],
    ),
    # One source file per part: language and planted flaws follow the part's attributes.
    "code_files": (
        "part",
        [
            "p_brand AS repo",
            "CASE WHEN p_size <= 5 THEN 'app/' || CAST(p_partkey AS STRING) || '.py' "
            "WHEN p_size <= 10 THEN 'lib/' || CAST(p_partkey AS STRING) || '.py' "
            "WHEN p_size <= 15 THEN 'web/' || CAST(p_partkey AS STRING) || '.js' "
            "WHEN p_size <= 20 THEN 'db/migrations/' || CAST(p_partkey AS STRING) || '.sql' "
            "WHEN p_size <= 25 THEN 'db/' || CAST(p_partkey AS STRING) || '.py' "
            "WHEN p_size <= 30 THEN 'log/' || CAST(p_partkey AS STRING) || '.py' "
            "WHEN p_size <= 35 THEN 'api/items' || CAST(p_partkey AS STRING) || '/[id]/route.ts' "
            "WHEN p_size <= 40 THEN 'api/views' || CAST(p_partkey AS STRING) || '.py' "
            "ELSE 'doc/' || CAST(p_partkey AS STRING) || '.md' END AS path",
            f"CASE WHEN p_size <= 5 THEN 'import os' || {NL} || 'sql = f' || {Q} || 'SELECT id FROM parts WHERE name = {{name}}' "
            f"|| {Q} || {NL} || 'cursor.execute(sql)' || {NL} || 'x = eval(data)' "
            f"WHEN p_size <= 10 THEN 'import hashlib' || {NL} || 'def digest(x):' || {NL} || '    return hashlib.md5(x)' || {NL} || "
            f"'r = requests.get(u, verify=False)' || {NL} || 'n = random.randint(1, ' || CAST(p_size AS STRING) || ')' "
            f"WHEN p_size <= 15 THEN 'import http from ' || {Q} || 'http' || {Q} || {NL} || 'const q = ' || {Q} || "
            f"'SELECT * FROM t WHERE n = ' || {Q} || ' + name' || {NL} || 'el.innerHTML = q' "
            f"|| {NL} || 'server.listen(' || CAST(3000 + p_size AS STRING) || ')' "
            f"WHEN p_size <= 20 THEN 'CREATE TABLE ' || replace(p_name, ' ', '_') || ' (' || {NL} || '  id INTEGER,' || {NL} || "
            f"'  size TEXT' || {NL} || ');' || {NL} || 'ALTER TABLE ' || replace(p_name, ' ', '_') || ' ADD COLUMN x TEXT;' "
            f"WHEN p_size <= 25 THEN 'import models' || {NL} || 'DB = ' || {Q} || 'postgres://svc:pw' || CAST(p_partkey AS STRING) || "
            f"'@db.local/' || replace(p_name, ' ', '_') || {Q} || {NL} || 'class Part(Base):' || {NL} || '    id = Column(Integer)' "
            f"WHEN p_size <= 30 THEN 'import logging' || {NL} || 'logger.info(password)' || {NL} || 'print(' || {Q} || 'ok' || {Q} || ')' "
            f"WHEN p_size <= 35 THEN 'export async function GET(request) {{' || {NL} || '}}' || {NL} || 'export async function PUT(request) {{' || {NL} || '}}' "
            f"WHEN p_size <= 40 THEN '@app.route(' || {Q} || '/views/' || CAST(p_partkey AS STRING) || {Q} || ', methods=[' || {Q} || 'POST' || {Q} || '])' "
            f"|| {NL} || 'def view():' || {NL} || '    return ' || {Q} || 'db error' || {Q} "
            f"ELSE '# ' || p_name || {NL} || 'Released under the MIT License.' END AS content",
        ],
    ),
    "chats": ("conversations", ["'chats' AS repo", "CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) || '.txt' AS path", "text AS content"]),
    # Requests that hide what they send: comments between words, signs encoded twice and three times, code in comments.
    "hidden_payloads": (
        "events",
        [
            "event_id AS req_id",
            "CASE event_type WHEN 'signup' THEN 'q=' || CAST(user_id AS STRING) || ' UNION/**/ALL/*x*/SELECT ' || CAST(event_id AS STRING) "
            "WHEN 'click' THEN 'q=1%252f%252a%252a%252fUNION%2520SELECT%25201,' || CAST(user_id AS STRING) "
            "WHEN 'view' THEN 'q=1 /*!50000UNION*/ /*!SELECT*/ ' || CAST(user_id AS STRING) "
            "WHEN 'error' THEN 'q=1%25252520AND%25252520SLEEP(5)%25252520' || CAST(user_id AS STRING) "
            "ELSE 'note=union of ' || CAST(user_id AS STRING) || ' clubs /* select */ 100%' END AS query",
        ],
    ),
    # Source that talks about calls as well as making them.
    "talking_files": (
        "part",
        [
            "p_brand AS repo",
            "'app/' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 3 = 0 THEN '.js' ELSE '.py' END AS path",
            f"CASE WHEN p_size % 3 = 0 THEN '// eval(a)' || {NL} || 'const s = ' || {Q} || 'eval(b) // no' || {Q} || ' + `eval(c)`;' || {NL} || '/* eval(d)' || {NL} || 'eval(e) */ eval(f' || CAST(p_size AS STRING) || ')' "
            f"WHEN p_size % 3 = 1 THEN '# eval(a) it' || {A} || 's' || {NL} || 's = ' || {Q} || 'eval(b) # ' || {Q} || ' + ' || {A} || 'exec(c)' || {A} || {NL} || 'x = eval(d' || CAST(p_size AS STRING) || ') # exec(e)' "
            f"ELSE {Q} || {Q} || {Q} || 'doc' || {NL} || 'exec(a)' || {NL} || {Q} || {Q} || {Q} || {NL} || 'exec(' || {A} || 'eval(' || CAST(p_size AS STRING) || ')' || {A} || ')' END AS content",
        ],
    ),
    # Modules that import each other: rings of five, a package import further down, one that is not in the repository.
    "module_files": (
        "part",
        [
            "p_brand AS repo",
            "'src/m' || CAST(p_partkey % 3 AS STRING) || '/p' || CAST(p_partkey AS STRING) || '.py' AS path",
            f"'import os' || {NL} || 'from m' || CAST((CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END) % 3 AS STRING) || '.p' "
            "|| CAST(CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END AS STRING) || ' import f' "
            f"|| CASE WHEN p_size % 2 = 0 THEN {NL} || 'from app.m' || CAST((p_partkey * 2 + 7) % 3 AS STRING) || '.p' || CAST(p_partkey * 2 + 7 AS STRING) || ' import g' ELSE '' END AS content",
        ],
    ),
    # One manifest per part.
    "manifests": (
        "part",
        [
            "p_brand AS repo",
            "CASE p_type WHEN 'ECONOMY' THEN 'requirements.txt' WHEN 'STANDARD' THEN 'package.json' "
            "WHEN 'PROMO' THEN 'Dockerfile' WHEN 'SMALL' THEN 'pom.xml' ELSE 'go.mod' END AS manifest",
            "CAST(p_partkey AS STRING) AS module",
            f"CASE p_type WHEN 'ECONOMY' THEN '# pinned' || {NL} || replace(p_name, ' ', '-') || '==' || CAST(p_size AS STRING) || '.0' "
            f"|| {NL} || 'base>=1.0' "
            f"WHEN 'STANDARD' THEN '{{' || {Q} || 'dependencies' || {Q} || ': {{' || {Q} || replace(p_name, ' ', '-') || {Q} || ': ' || {Q} || '^' "
            f"|| CAST(p_size AS STRING) || {Q} || '}}, ' || {Q} || 'devDependencies' || {Q} || ': {{' || {Q} || 'lint' || {Q} || ': ' || {Q} || '9.0.1' || {Q} || '}}}}' "
            f"WHEN 'PROMO' THEN 'FROM ' || replace(p_name, ' ', '-') || ':' || CAST(p_size AS STRING) || '-slim' || {NL} || 'EXPOSE 5000' "
            f"WHEN 'SMALL' THEN '<dependency><groupId>org.acme</groupId><artifactId>' || replace(p_name, ' ', '-') || "
            f"'</artifactId><version>' || CAST(p_size AS STRING) || '.1</version></dependency>' "
            f"ELSE 'module acme' || {NL} || 'require example.org/' || replace(p_name, ' ', '-') || ' v' || CAST(p_size AS STRING) || '.2.0' END AS content",
        ],
    ),
    # Lines of injection-scanner logs: one file per user, one block per event.
    "scanner_lines": (
        "events",
        [
            "'scan-' || CAST(user_id AS STRING) || '.log' AS file",
            "event_id AS n",
            f"CASE event_type WHEN 'signup' THEN '[*] starting @ 14:' || CAST(user_id AS STRING) "
            f"WHEN 'purchase' THEN '[*] ending @ 15:' || CAST(user_id AS STRING) "
            f"WHEN 'view' THEN 'back-end DBMS: SQLite' "
            f"WHEN 'click' THEN '[INFO] testing connection' "
            f"ELSE 'Parameter: p' || CAST(user_id AS STRING) || ' (GET)' || {NL} || '    Type: boolean-based blind' || {NL} || "
            f"'    Title: AND boolean-based blind' || {NL} || '    Payload: id=1 AND ' || CAST(event_id AS STRING) || '=' || CAST(event_id AS STRING) END AS block",
        ],
    ),
    # The chats with their assistants calling tools: calls, other JSON and text; results, failures and other requests.
    "agent_messages": (
        "conversations",
        [
            "conv_id", "turn", "role",
            f"CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 < 3 THEN '{{' || {Q} || 'method' || {Q} || ':' || {Q} || 'tools.scan' || CAST(turn % 3 AS STRING) || {Q} || ',' || {Q} || 'params' || {Q} || ':{{' "
            f"|| {Q} || 'n' || {Q} || ':' || CAST(conv_id AS STRING) || '}}}}' "
            f"WHEN role = 'assistant' AND (conv_id + turn) % 5 = 3 THEN '{{' || {Q} || 'method' || {Q} || ':' || {Q} || 'chat' || {Q} || '}}' "
            f"WHEN role = 'user' AND turn > 0 AND (conv_id + turn) % 7 = 0 THEN 'Tool ' || {A} || 'tools.scan' || CAST(turn % 3 AS STRING) || {A} || ' executed with result:' || {NL} || 'None' || {NL} || {NL} || 'Continue reasoning or provide next instructions.' "
            f"WHEN role = 'user' AND turn > 0 AND (conv_id + turn) % 7 = 1 THEN 'Tool ' || {A} || 'tools.scan' || CAST(turn % 3 AS STRING) || {A} || ' executed with result:' || {NL} || '{{' || {Q} || 'error' || {Q} || ': {{}}}}' || {NL} || {NL} || 'Continue reasoning or provide next instructions.' "
            f"WHEN role = 'user' AND turn > 0 AND (conv_id + turn) % 7 < 6 THEN 'Tool ' || {A} || 'tools.scan' || CAST(turn % 3 AS STRING) || {A} || ' executed with result:' || {NL} || text || {NL} || {NL} || 'Continue reasoning or provide next instructions.' "
            "ELSE text END AS text",
        ],
    ),
    # One API description per page, as JSON text.
    "spec_files": (
        "pages",
        [
            "CAST(page_id AS STRING) || '.json' AS path",
            f"'{{' || {Q} || 'openapi' || {Q} || ':' || {Q} || '3.0.3' || {Q} || ',' || {Q} || 'servers' || {Q} || ':[{{' || {Q} || 'url' || {Q} || ':' || {Q} || "
            f"regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || {Q} || '}}],' || {Q} || 'paths' || {Q} || ':{{' || {Q} || "
            f"'/api/' || CAST(page_id AS STRING) || {Q} || ':{{' || {Q} || 'get' || {Q} || ':{{' || {Q} || 'summary' || {Q} || ':' || {Q} || 'Read' || {Q} || ',' || "
            f"{Q} || 'parameters' || {Q} || ':[{{' || {Q} || 'name' || {Q} || ':' || {Q} || 'q' || {Q} || ',' || {Q} || 'in' || {Q} || ':' || {Q} || 'query' || {Q} || ',' || "
            f"{Q} || 'required' || {Q} || ':true,' || {Q} || 'schema' || {Q} || ':{{' || {Q} || 'type' || {Q} || ':' || {Q} || 'string' || {Q} || '}}}}],' || "
            f"{Q} || 'responses' || {Q} || ':{{' || {Q} || '200' || {Q} || ':{{' || {Q} || 'description' || {Q} || ':' || {Q} || 'ok' || {Q} || ',' || {Q} || 'content' || {Q} || ':{{' || "
            f"{Q} || 'application/json' || {Q} || ':{{' || {Q} || 'schema' || {Q} || ':{{' || {Q} || '$ref' || {Q} || ':' || {Q} || '#/components/schemas/Page' || {Q} || '}}}}}}}}}}}}}}}},' || "
            f"{Q} || 'components' || {Q} || ':{{' || {Q} || 'schemas' || {Q} || ':{{' || {Q} || 'Page' || {Q} || ':{{' || {Q} || 'type' || {Q} || ':' || {Q} || 'object' || {Q} || ',' || "
            f"{Q} || 'properties' || {Q} || ':{{' || {Q} || 'id' || {Q} || ':{{' || {Q} || 'type' || {Q} || ':' || {Q} || 'integer' || {Q} || '}},' || {Q} || 'title' || {Q} || ':{{' || "
            f"{Q} || 'type' || {Q} || ':' || {Q} || 'string' || {Q} || '}},' || {Q} || 'owner' || {Q} || ':{{' || {Q} || '$ref' || {Q} || ':' || {Q} || '#/components/schemas/Owner' || {Q} || '}}}}}},' || "
            f"{Q} || 'Owner' || {Q} || ':{{' || {Q} || 'type' || {Q} || ':' || {Q} || 'object' || {Q} || ',' || {Q} || 'properties' || {Q} || ':{{' || {Q} || 'email' || {Q} || ':{{' || "
            f"{Q} || 'type' || {Q} || ':' || {Q} || 'string' || {Q} || ',' || {Q} || 'maxLength' || {Q} || ':254}}}}}}}}}}}}' AS content",
        ],
    ),
    "spec_yaml": ("pages", ["CAST(page_id AS STRING) AS path", _page_text(_YAML, "security: []\n", '        "401":\n          description: who\n') + " AS content"]),
    "spec_json": ("pages", ["CAST(page_id AS STRING) AS path", _page_text(_JSON, '"security":[],', ',"401":{"description":"who"}') + " AS content"]),
}


class Tables:
    """Lazy access to the base tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def path(self, name: str) -> str:
        return os.path.join(self.dir, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self._read(name)
        if name in VIEWS:
            base, exprs = VIEWS[name]
            return self._read(base).selectExpr(*exprs)
        raise AttributeError(name)

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        if name not in TEXT_HEAVY:
            return df
        # The local test tables are one row group each, hence one task; only a local session deals them out.
        context = self.spark.sparkContext
        return df.repartition(context.defaultParallelism) if context.master.startswith("local[") else df

    @property
    def posts(self) -> DataFrame:
        d = self.documents
        lab = self.labels.select("doc_id", "quality")
        return d.join(lab, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            F.substring("text", 1, 40).alias("title"),
            F.col("text").alias("content"),
            (F.col("doc_id") % 150).alias("author_id"),
            F.array("lang", "source").alias("tags"),
            (F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("published"),
        )

    @property
    def categories(self) -> DataFrame:
        n, r = self.nation, self.region
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("description"),
            (F.col("n_nationkey") % 2 == 0).alias("active"),
        )

    @property
    def events_utc(self) -> DataFrame:
        """Events with ``ts`` as an instant (session time zone UTC)."""
        return self.events.withColumn("ts", F.col("ts").cast("timestamp"))


def view_sql(name: str) -> str:
    """The SELECT behind a view, for the oracle side."""
    base, exprs = VIEWS[name]
    return f"SELECT {', '.join(exprs)} FROM {base}"
