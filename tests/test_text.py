"""Classification, question analysis, sections, pages, extraction."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.functions import analysis, classify, extract, text
from lodestone.operators import chunking


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_trim_is_unicode_aware(spark):
    assert one(spark, "﻿ \t\x0b a b 　\r\n", text.js_trim) == "a b"
    assert one(spark, "  ", text.is_blank) is True


def test_file_types_in_order(spark):
    cases = {
        "a/user.controller.ts": "controller", "a/user.service.spec.ts": "service", "x.module.ts": "module", "x.entity.ts": "entity", "x.dto.ts": "dto", "x.guard.ts": "guard",
        "x.interceptor.ts": "interceptor", "x.pipe.ts": "pipe", "x.middleware.ts": "middleware", "x.resolver.ts": "resolver", "x.gateway.ts": "gateway", "x.strategy.ts": "strategy",
        "x.repository.ts": "repository", "x.interface.ts": "interface", "x.enum.ts": "enum", "x.configuration.ts": "config", "x.test.ts": "test", "x.TSX": "component",
        "s/pages/i.ts": "page", "s/hooks/i.ts": "hook", "s/utils/i.ts": "util", "s/models/i.ts": "model", "s/router.ts": "route", "s/x.ts": "unknown", "/home/user/x.ts": "hook",
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", classify.file_type(F.col("p")).alias("t")).collect()
    assert {r["p"]: r["t"] for r in rows} == cases
    langs = {"a.ts": "typescript", "a.b.TSX": "typescript-react", "x/.py": "unknown", "c.c": "c", "noext": "unknown", "d.ir/x": "unknown"}
    rows = spark.createDataFrame([(p,) for p in langs], "p string").select("p", classify.language(F.col("p")).alias("t"), classify.document_type(F.col("p")).alias("d")).collect()
    assert {r["p"]: r["t"] for r in rows} == langs and {r["d"] for r in rows} == {"text"}


def test_question_analysis(spark):
    q = spark.createDataFrame(
        [(1, "How does the OrderService, éFoo User Foo_Bar x use ORDER api? 구조 의 order!"), (2, "orderapi and user"), (3, "nothing here"), (4, "order-api user-web")],
        "query_id long, question string",
    )
    rows = {r["query_id"]: r for r in analysis.analyse(q, ["user-web", "order-api", "shop-user"]).collect()}
    assert rows[1]["keywords"] == ["orderservice", "éfoo", "user", "foo_bar", "use", "order", "api", "구조"]
    assert rows[1]["entityNames"] == ["OrderService", "Foo", "User"] and rows[1]["isArchitectural"] and rows[1]["fileTypeFilter"] == "service"
    assert [rows[k]["serviceFilter"] for k in (1, 2, 3, 4)] == ["order-api", "order-api", None, "user-web"]
    assert not rows[3]["isArchitectural"] and rows[3]["fileTypeFilter"] is None


def test_markdown_sections(spark):
    sections = lambda t: [(s["heading"], s["level"], s["content"]) for s in one(spark, t, chunking.markdown_sections)]
    assert sections("intro\n# A\ntext\n## B\n\n### C \nmore\n```\n# x\ny\n```") == [("", 0, "intro"), ("A", 1, "text"), ("C ", 3, "more\n```"), ("x", 1, "y\n```")]
    assert sections("####### seven\n#none") == [("", 0, "####### seven\n#none")]
    assert sections("# only\n# heads") == [("", 0, "# only\n# heads")]
    assert sections("# A\r\ntext") == [("", 0, "# A\r\ntext")]
    assert sections(" \n ") == []


def test_pages(spark):
    df = spark.createDataFrame([("a\fb\f \fc", 4), ("abcdef", 3), (" x ", 1), ("", 0)], "t string, n int")
    got = [[tuple(p) for p in r[0]] for r in df.select(chunking.text_pages(F.col("t"), F.col("n"))).collect()]
    assert got == [[(1, "a"), (2, "b"), (4, "c")], [(1, "ab"), (2, "cd"), (3, "ef")], [(1, "x")], []]


CONTROLLER = """import { A } from './a'
import B from "b"
import {
  C
} from 'c'
@Controller('/users')
@UseGuards(Top)
export class UserController {
  constructor(private readonly a: AService, public b: B) {}
  @Get()
  @UseGuards(G1, G2)
  list() {}
  @UseInterceptors(I)
  @Get(':id')
  async one(id) {}
  @Post('new')
  make() {}
}
"""


def test_source_extraction(spark):
    imports, exports = one(spark, CONTROLLER, extract.imports), one(spark, CONTROLLER, extract.exports)
    assert imports == ["./a", "b"] and exports == ["UserController"]
    assert one(spark, CONTROLLER, extract.decorators) == ["Controller", "UseGuards", "Get", "UseInterceptors", "Post"]
    assert one(spark, CONTROLLER, extract.role) == "controller" and one(spark, "plain", extract.role) is None
    routes = [(r["method"], r["path"], r["handlerName"], r["guards"], r["interceptors"]) for r in one(spark, CONTROLLER, extract.controller_routes)]
    # What follows a verb's decorator is its handler, even a guard.
    assert routes == [("GET", "/users", "UseGuards", ["G1", "G2"], ["I"]), ("GET", "/users/:id", "one", [], []), ("POST", "/users/new", "make", [], [])]
    assert one(spark, CONTROLLER, extract.injectable_deps) == ["AService", "B"]
    inject = "constructor(@Inject('A') private a: A, private b: B)"
    assert one(spark, inject, extract.injectable_deps) == []
    assert one(spark, inject, lambda c: extract.injectable_deps(c, True)) == ["A", "B"]


def test_relations_modules_and_occurrences(spark):
    entity = "@Entity()\nclass E {\n  @OneToMany(() => Item, (i) => i.owner)\n  items: Item[];\n  @ManyToOne(() => User, u => u.x) @JoinColumn()\n  user: User;\n  @OneToOne(() => P)\n  @JoinColumn()\n  p: P;\n}\n"
    got = [tuple(r) for r in one(spark, entity, extract.entity_relations)]
    assert got == [("OneToOne", "P", None, False), ("OneToMany", "Item", "i.owner", False), ("ManyToOne", "User", None, True)]
    module = "x\n@Module({\n imports: [A, B.forRoot({ a: [1] }), C(D)],\n})"
    assert one(spark, module, extract.module_imports) == ["A", "B.forRoot", "C"]
    assert one(spark, module[2:], extract.module_imports) == []
    got = one(spark, "@Injectable()\nexport class Foo {\n constructor(a) {}\n @Column(1)\n  name: string;\n}", extract.decorator_occurrences)
    assert [tuple(r) for r in got] == [("Injectable", [], "constructor"), ("Column", ["1"], "name")]
    df = spark.createDataFrame([Row(content=c, serviceName="s", fileType="t", language="l", lineCount=3) for c in (CONTROLLER, entity, module, "plain", "@Injectable() x")])
    summaries = {r["summary"] for r in extract.with_framework(df).collect()}
    assert "t 파일 (s). l, 3 lines" in summaries and "서비스 (s). Dependencies: none" in summaries and any(x.startswith("REST 컨트롤러 (s). Routes: GET /users, ") for x in summaries)


def test_file_summary_and_ids(spark):
    df = spark.createDataFrame([("/r/a.ts", "a.ts", "svc", "service", "typescript", "import x\nexport y\nz")], "filePath string, relativePath string, serviceName string, fileType string, language string, content string")
    first = chunking.chunk_code(df).orderBy("level").first()
    assert first["content"] == "// File: a.ts\n// Service: svc\n// Type: service\n// Lines: 3\n\n// Imports:\nimport x\n\n// Exports:\nexport y"
    import hashlib

    assert first["id"] == hashlib.sha256(b"/r/a.ts:0:0").hexdigest()[:16]
