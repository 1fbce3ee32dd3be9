"""A small invented source tree, logs and diffs, as literals for queries and tests."""

from __future__ import annotations

from quillmesh.plans.values import Grown, Values

FILES = Values("path string, content string", [
    ("package.json", '{"name": "shop", "scripts": {"test": "vitest"}}'),
    ("composer.json", '{"require": {"laravel/framework": "^11"}}'),
    ("tsconfig.json", '{"compilerOptions": {}}'),
    ("src/index.ts", "import { CartService } from './cart/cartService.js';\nimport express from 'express';\nimport '@/lib/logger';\n\nexport function main(port: number) {\n  const cart = new CartService();\n  return cart.total(port);\n}\n"),
    ("src/cart/cartService.ts", "import { Price } from '../lib/price';\nimport type { Order } from './order';\n\nexport abstract class CartService {\n  private items: Order[] = [];\n\n  public async total(rate: number): number {\n    if (rate > 0) {\n      return this.items.length * rate;\n    }\n    return 0;\n  }\n}\n\nexport const emptyCart = () => [];\n"),
    ("src/cart/order.ts", "export interface Order {\n  id: string;\n}\n\nexport type OrderId = string;\n"),
    ("src/cart/index.ts", "export * from './order';\nconst lazy = import('./cartService');\n"),
    ("src/lib/price.ts", "const base = require('../cart/order');\nexport function roundPrice(x: number) {\n  return Math.round(x);\n}\n"),
    ("lib/logger.js", "function logLine(text) {\n  console.log(text);\n}\nmodule.exports = { logLine };\n"),
    ("src/cart/__tests__/cartService.ts", "import { CartService } from '../cartService';\ntest('total', () => {\n});\n"),
    ("src/cart/cartService.test.ts", "import { CartService } from './cartService';\n"),
    ("src/userController.js", "class UserController {\n  show(req) {\n    return req;\n  }\n}\n"),
    ("src/userService.js", "async function loadUser(id) {\n  return id;\n}\n"),
    ("app/Http/Controllers/InvoiceController.php", "<?php\nnamespace App\\Http\\Controllers;\n\nuse App\\Models\\Invoice;\nuse Illuminate\\Http\\Request;\n\nclass InvoiceController extends Controller\n{\n    public function store(Request $request)\n    {\n        return Invoice::create($request->all());\n    }\n\n    public static function listAll() {\n        return app(InvoiceService::class)->fetchOpen();\n    }\n}\n"),
    ("app/Models/Invoice.php", "<?php\nclass Invoice extends Model\n{\n    public function customer()\n    {\n        return $this->belongsTo(Customer::class);\n    }\n}\n"),
    ("app/Models/Customer.php", "<?php\nfinal class Customer {}\n"),
    ("app/Http/Requests/StoreInvoiceRequest.php", "<?php\nclass StoreInvoiceRequest {}\n"),
    ("resources/views/invoice/show.blade.php", "<h1>Invoice</h1>\n"),
    ("routes/web.php", "<?php\nRoute::get('/invoices', [InvoiceController::class, 'listAll']);\nRoute::post('/invoices', 'InvoiceController@store');\n"),
    ("database/migrations/2024_01_01_create_invoices_table.php", "<?php\nreturn new class {};\n"),
    ("config/payments.php", "<?php\nreturn ['currency' => 'EUR'];\n"),
    ("jobs/report.py", "import os\nfrom jobs.util import chunk\nfrom .util import flat\n\n\nclass Report:\n    def rows(self):\n        return chunk(flat([1]))\n\n\nasync def build(report):\n    return report.rows()\n"),
    ("jobs/util.py", "def chunk(xs):\n    return [xs]\n\n\ndef flat(xs):\n    return xs\n"),
    ("jobs/__init__.py", "from jobs.report import Report\n"),
    ("docs/guide.md", "See `InvoiceController::store()` and [the cart](src/cart/cartService.ts).\nPOST /invoices creates one; run `loadUser()`.\nOld notes: ./lib/logger.js and http://example.com/x.md\n"),
    ("cmd/main.go", "package main\n\nimport (\n\t\"fmt\"\n\t\"shop/pkg/store\"\n)\n\ntype Server struct {\n\tname string\n}\n\nfunc (s *Server) Start() {\n\tfmt.Println(store.Open())\n}\n"),
    ("pkg/store.go", "package store\n\nfunc Open() string {\n\treturn \"ok\"\n}\n"),
])

LOGS = Values("id long, content string", [
    (1, "TypeError: Cannot read properties of undefined at total\n    at CartService.total (/srv/shop/src/cart/cartService.ts:7:12)\n    at main (/srv/shop/src/index.ts:6:3)\n    at run (/srv/shop/node_modules/tsx/run.js:1:1)\n"),
    (2, "PHP Fatal error: Uncaught Exception: Payment gateway timed out in /var/www/app/Http/Controllers/InvoiceController.php:11\n#0 /var/www/app/Http/Controllers/InvoiceController.php(11): App\\Models\\Invoice::create()\n#1 /var/www/vendor/laravel/Router.php(77): run()\n#2 /var/www/app/Models/Invoice.php(6): belongsTo()\nSee config.php on line 3\n"),
    (3, "Traceback (most recent call last):\n  File \"/opt/app/jobs/report.py\", line 8, in rows\n    return chunk()\nValueError: empty chunk list\n"),
    (4, "panic: boom\nmain.go:13 +0x1d\n\tat com.acme.shop.Billing.charge(Billing.java:42)\nlib/worker.rb:9:in `perform'\nsrc/net/tcp.rs:101:5\n"),
    (5, "nothing of interest here\n"),
])

TIMED = Values("id long, line int, body string", [
    (1, 1, "start without a time"), (1, 2, "[2024-01-10 09:00:00] old error"), (1, 3, "  at old frame"), (1, 4, "2024-01-12T10:30:00 new error"), (1, 5, "  at new frame"), (1, 6, "2024-01-11 08:00:00 late writer"), (1, 7, "  its frame"),
    (2, 1, "2024-01-20 00:00:00 only"), (2, 2, ""),
])

STATUSES = Values("id long, content string", [(1, "M\tsrc/index.ts\nA\tsrc/cart/order.ts\nD\told/gone.ts\nR087\tlib/log.js\tlib/logger.js\n"), (2, "M\tREADME.md\n")])
NUMSTATS = Values("id long, content string", [(1, "10\t2\tsrc/index.ts\n5\t0\tsrc/cart/order.ts\n0\t44\told/gone.ts\n-\t-\tlib/logger.js\n"), (2, "1\t1\tREADME.md\n")])
HUNKS = Values("id string, content string", [("src/index.ts", "@@ -1,2 +1,3 @@ import\n+a\n+b\n@@ -10 +12 @@\n+c\n@@ -20,3 +21,0 @@\n-d\n"), ("lib/logger.js", "@@ -0,0 +1,2 @@\n+x\n+y\n")])

TASKS = Values("query long, text string", [
    (1, "Fix the broken checkout: CartService.total returns wrong price in src/cart/cartService.ts"),
    (2, "Add an invoice endpoint POST /invoices to InvoiceController and a new migration for invoices"),
    (3, "Refactor the jobs report so chunk and flat move to a helper, see @jobs/report.py"),
    (4, "The page is slow, cache the user profile query and improve memory"),
    (5, "PAYMENT_FAILED with 502 after login, check token permission and csrf injection"),
    (6, "help"),
    (7, ""),
    (8, "manage_credit and loadUser should support the ui db api"),
])

RULES = "# build\ndist/\n*.log\n!keep.log\n/docs/*.md\n**/fixtures/**\nsrc/*/tmp\n.env.*\n!.env.example\n"
PATHS = Values("path string", [(p,) for p in (
    "dist/app.js", "src/dist/app.js", "dist", "a/b.log", "keep.log", "logs/keep.log", "docs/a.md", "docs/sub/a.md", "x/docs/a.md", "tests/fixtures/a/b.txt", "fixtures/c.txt", "src/a/tmp/f.txt", "src/a/b/tmp/f.txt", "src/a/tmp",
    ".env.local", ".env.example", ".vscode/settings.json", "a/.idea/x.xml", "a/b.swp", ".DS_Store", "src/index.ts", "logs\\win.log")])

# What the extractors have to find in the tables above, read off by eye.
SYMBOLS = Values("path string, line int, kind string, name string", [
    ("app/Http/Controllers/InvoiceController.php", 7, "class", "InvoiceController"), ("app/Http/Controllers/InvoiceController.php", 9, "function", "store"), ("app/Http/Controllers/InvoiceController.php", 14, "function", "listAll"),
    ("app/Http/Requests/StoreInvoiceRequest.php", 2, "class", "StoreInvoiceRequest"), ("app/Models/Customer.php", 2, "class", "Customer"), ("app/Models/Invoice.php", 2, "class", "Invoice"), ("app/Models/Invoice.php", 4, "function", "customer"),
    ("cmd/main.go", 8, "class", "Server"), ("cmd/main.go", 12, "function", "Start"), ("jobs/report.py", 6, "class", "Report"), ("jobs/report.py", 7, "function", "rows"), ("jobs/report.py", 11, "function", "build"),
    ("jobs/util.py", 1, "function", "chunk"), ("jobs/util.py", 5, "function", "flat"), ("lib/logger.js", 1, "function", "logLine"), ("pkg/store.go", 3, "function", "Open"),
    ("src/cart/cartService.ts", 4, "class", "CartService"), ("src/cart/cartService.ts", 7, "method", "total"), ("src/cart/cartService.ts", 15, "function", "emptyCart"), ("src/cart/order.ts", 1, "interface", "Order"), ("src/cart/order.ts", 5, "interface", "OrderId"),
    ("src/index.ts", 5, "function", "main"), ("src/lib/price.ts", 2, "function", "roundPrice"), ("src/userController.js", 1, "class", "UserController"), ("src/userController.js", 2, "method", "show"), ("src/userService.js", 1, "function", "loadUser")])
IMPORTS = Values("path string, gr string, spec string", [
    ("app/Http/Controllers/InvoiceController.php", "php", "App\\Models\\Invoice"), ("cmd/main.go", "go", "shop/pkg/store"), ("jobs/__init__.py", "python", "jobs.report"), ("jobs/report.py", "python", ".util"), ("jobs/report.py", "python", "jobs.util"),
    ("src/cart/__tests__/cartService.ts", "typescript", "../cartService"), ("src/cart/cartService.test.ts", "typescript", "./cartService"), ("src/cart/cartService.ts", "typescript", "../lib/price"), ("src/cart/cartService.ts", "typescript", "./order"),
    ("src/cart/index.ts", "typescript", "./cartService"), ("src/index.ts", "typescript", "./cart/cartService.js"), ("src/index.ts", "typescript", "@/lib/logger"), ("src/lib/price.ts", "typescript", "../cart/order")])
FRAMES = Values("id long, ord int, grammar string, file string, line int, col int, function string, message string", [
    (1, 1, "javascript", "src/cart/cartService.ts", 7, 12, "CartService.total", "Cannot read properties of undefined"), (1, 2, "javascript", "src/index.ts", 6, 3, "main", None),
    (2, 1, "php", "app/Http/Controllers/InvoiceController.php", 11, None, "App\\Models\\Invoice::create()", "Uncaught Exception: Payment gateway timed out"), (2, 2, "php", "app/Models/Invoice.php", 6, None, "belongsTo()", None), (2, 3, "php-line", "config.php", 3, None, None, None),
    (3, 1, "python", "app/jobs/report.py", 8, None, "rows", "empty chunk list"), (4, 1, "java", "com/acme/shop/Billing.java", 42, None, "charge", None), (4, 2, "go", "main.go", 13, None, None, None), (4, 3, "ruby", "lib/worker.rb", 9, None, "perform", None), (4, 4, "rust", "src/net/tcp.rs", 101, 5, None, None)])
MESSAGES = Values("id long, ord int, message string", [(1, 1, "Cannot read properties of undefined"), (2, 1, "Uncaught Exception: Payment gateway timed out"), (2, 2, "Payment gateway timed out"), (3, 1, "empty chunk list")])
REFERENCES = Values("path string, kind string, ref string", [(p, k, r) for p, k, rs in (
    ("app/Http/Controllers/InvoiceController.php", "class", "Controller Invoice InvoiceController InvoiceService Request"), ("app/Http/Controllers/InvoiceController.php", "method", "fetchOpen listAll store"), ("app/Http/Requests/StoreInvoiceRequest.php", "class", "StoreInvoiceRequest"),
    ("app/Models/Invoice.php", "class", "Customer Model"), ("app/Models/Invoice.php", "method", "belongsTo customer"), ("docs/guide.md", "class", "InvoiceController"), ("docs/guide.md", "method", "loadUser store"), ("docs/guide.md", "path", "lib/logger.js src/cart/cartService.ts"),
    ("lib/logger.js", "method", "logLine"), ("routes/web.php", "class", "InvoiceController Route"), ("routes/web.php", "method", "listAll post"), ("src/cart/__tests__/cartService.ts", "class", "CartService"), ("src/cart/cartService.test.ts", "class", "CartService"),
    ("src/cart/cartService.ts", "class", "CartService"), ("src/index.ts", "class", "CartService"), ("src/index.ts", "method", "main"), ("src/index.ts", "path", "cart/cartService.js"), ("src/lib/price.ts", "method", "roundPrice"), ("src/userController.js", "class", "UserController"), ("src/userService.js", "method", "loadUser"),
) for r in rs.split()] + [("docs/guide.md", "route", "POST /invoices"), ("routes/web.php", "route", "GET /invoices"), ("routes/web.php", "route", "POST /invoices")])

# The same tables with rows of all documents: a source file, a log, a diff and so on for each, and what they say by the
# way they are made. Expressions are SQL for both engines.
_NL, _TAB, _BACK = "chr(10)", "chr(9)", "chr(92)"
_TS, _PY, _PHP = "doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2"
_UNIT = "'gen/d' || (doc_id % 20) || '/unit_' || doc_id"
_PATH = {w: f"{_UNIT} || '.{e}'" for w, e in ((_TS, "ts"), (_PY, "py"), (_PHP, "php"))}
_BODY = {
    _TS: f"""'import {{ U }} from "./unit_' || (doc_id + 60) || '";' || {_NL} || {_NL} || 'export class Unit' || doc_id || ' {{' || {_NL} || '  run' || doc_id || '(x: number) {{' || {_NL} || '    return x;' || {_NL} || '  }}' || {_NL} || '}}' || {_NL} || '// ' || source || {_NL}""",
    _PY: f"""'from .unit_' || (doc_id + 60) || ' import a' || {_NL} || 'class Unit' || doc_id || ':' || {_NL} || '    def run' || doc_id || '(self):' || {_NL} || '        return 1' || {_NL}""",
    _PHP: f"""'<?php' || {_NL} || 'use App' || {_BACK} || 'Gen' || {_BACK} || 'Unit' || (doc_id + 60) || ';' || {_NL} || 'final class Unit' || doc_id || ' {{' || {_NL} || '    public function run' || doc_id || '() {{' || {_NL} || '        return new Helper' || doc_id || '();' || {_NL} || '    }}' || {_NL} || '}}' || {_NL}""",
}
_LINES = {_TS: (3, 4, "method"), _PY: (2, 3, "function"), _PHP: (3, 4, "function")}
FILES = Grown(FILES, *[("documents", w, [_PATH[w], _BODY[w]]) for w in _BODY])
SYMBOLS = Grown(SYMBOLS, *[("documents", w, [_PATH[w], str(c), "'class'", "'Unit' || doc_id"]) for w, (c, _, _) in _LINES.items()], *[("documents", w, [_PATH[w], str(m), f"'{k}'", "'run' || doc_id"]) for w, (_, m, k) in _LINES.items()])
IMPORTS = Grown(IMPORTS, ("documents", _TS, [_PATH[_TS], "'typescript'", "'./unit_' || (doc_id + 60)"]), ("documents", _PY, [_PATH[_PY], "'python'", "'.unit_' || (doc_id + 60)"]),
                ("documents", _PHP, [_PATH[_PHP], "'php'", f"'App' || {_BACK} || 'Gen' || {_BACK} || 'Unit' || (doc_id + 60)"]))
REFERENCES = Grown(REFERENCES, *[("documents", _PHP, [_PATH[_PHP], f"'{k}'", r]) for k, r in (("class", "'Unit' || (doc_id + 60)"), ("class", "'Helper' || doc_id"), ("method", "'run' || doc_id"))])
_ID, _EVERY = "1000 + doc_id", "doc_id IS NOT NULL"
LOGS = Grown(LOGS, ("documents", _EVERY, [_ID, f"""'ValueError: bad value ' || doc_id || {_NL} || '  File "/opt/app/gen/unit_' || doc_id || '.py", line ' || (doc_id % 50 + 1) || ', in run' || doc_id || {_NL}"""]))
FRAMES = Grown(FRAMES, ("documents", _EVERY, [_ID, "1", "'python'", "'app/gen/unit_' || doc_id || '.py'", "doc_id % 50 + 1", "NULL", "'run' || doc_id", "'bad value ' || doc_id"]))
MESSAGES = Grown(MESSAGES, ("documents", _EVERY, [_ID, "1", "'bad value ' || doc_id"]))
TIMED = Grown(TIMED, ("documents", _EVERY, [_ID, "1", "'[2024-01-' || (10 + doc_id % 5) || ' 00:00:00] begin'"]), ("documents", _EVERY, [_ID, "2", "'then ' || source"]))
STATUSES = Grown(STATUSES, ("documents", _EVERY, [_ID, f"'M' || {_TAB} || 'gen/unit_' || doc_id || '.py' || {_NL} || 'D' || {_TAB} || 'old/' || source"]))
NUMSTATS = Grown(NUMSTATS, ("documents", _EVERY, [_ID, f"(doc_id % 9) || {_TAB} || (doc_id % 4) || {_TAB} || 'gen/unit_' || doc_id || '.py'"]))
HUNKS = Grown(HUNKS, ("documents", _EVERY, ["'unit_' || doc_id", f"'@@ -1,2 +' || (doc_id % 90 + 1) || ',' || (doc_id % 4) || ' @@ x' || {_NL}"]))
PATHS = Grown(PATHS, ("documents", _TS, ["'dist/unit_' || doc_id || '.js'"]), ("documents", _PY, ["'src/unit_' || doc_id || '.js'"]), ("documents", _PHP, ["'logs/unit_' || doc_id || '.log'"]))
