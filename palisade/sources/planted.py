"""Code-like texts planted into the prose tables so that every rule meets hits and
near misses. Each entry is a path, a head put before a document's text and a tail
put after it; the labelled cases are entries too."""

from __future__ import annotations

from dataclasses import dataclass

from palisade.settings import PREFIX
from palisade.sources.labelled import CASES, GITHUB_ENV, OPENAI, PINECONE


@dataclass(frozen=True)
class Planted:
    path: str
    head: str
    tail: str


AWS = "AK" + "IA" + "Q3ZT7XPLW2M9KDVB"
AWS_FLAT = "AK" + "IA" + "A" * 16
HUGGING_FACE = "hf_" + "QwErTyUiOpAsDfGhJkLzXcVbNm123456"
SLACK_BOT = "xoxb-" + "2401298374-aBcDeFgHiJkL"
GITHUB_FINE = "github_" + "pat_11AB0Z9QX0yT8vLmN3pRsW_kJ"
VECTOR_KEY = "qd9xK1mQ8zLp7vW2rT4yU6iO0e"
MONGO = "mongodb+srv://svc:" + "pa55word" + "@cluster0.example.net"
ALPHABET = "sk-" + "proj-" + "abcdefgh" * 4

_EXTRA = (
    Planted("infra/aws.py", "", f'AWS_ID = "{AWS}"\nOLD_ID = "{AWS_FLAT}"'),
    Planted("ml/hub.py", f"HF = '{HUGGING_FACE}'", f"again = '{HUGGING_FACE}' or '{HUGGING_FACE}'"),
    Planted("bots/slack.js", "", f'const token = "{SLACK_BOT}", other = "{SLACK_BOT}";'),
    Planted("ci/release.yml", f"token: {GITHUB_FINE}", "steps:\n  - run: make"),
    Planted("db/mongo.mjs", "", f"const uri = '{MONGO}/app';\nconst plain = 'mysql://db.local/app';"),
    Planted("src/alphabet.ts", "", f'const a = "{ALPHABET}";\nconst b = "{OPENAI}";'),
    Planted("agent/run_code.py", "import ast", "result = exec(generated_code)\nvalue = ast.literal_eval(x)"),
    Planted("src/sandbox.jsx", "", "const fn = new Function('x', aiOutput);\nvm.runInThisContext(result);"),
    Planted("src/math.ts", "", "const total = evaluate(response);\nconst v = eval('1 + 1');"),
    Planted("tools/shell.py", "import os", 'os.system(f"ls {user_input}")\nos.system("ls")'),
    Planted("tools/popen.py", "import subprocess",
            'subprocess.Popen(["ls"], shell=False)\nsubprocess.run("ls",\n  shell = True)'),
    Planted("src/chat.ts", "import OpenAI from 'openai';",
            "const a = await openai.chat.completions.create({ model, messages: [ask(')')] });\n"
            "const b = await client.completions.create(options);\n"
            "const c = await openai.chat.completions.create({ max_completion_tokens: 9 });"),
    Planted("src/nested.ts", "",
            "const x = await openai.chat.completions.create({ prompt: await "
            "client.completions.create({ n: 1 }), note: 'it\\'s (open' });\nconst max_tokens = 5;"),
    Planted("agent/unclosed.py", "", "r = client.chat.completions.create(model='m', messages=["),
    Planted("agent/memory.py", "import pickle",
            "state = pickle.loads(agent_state)\ncfg = yaml.unsafe_load(cache.read())\n"
            "ok = pickle.loads(blob)"),
    Planted("src/session.tsx", "", "const s = deserialize(sessionStore.get(id));"),
    Planted("src/vectors.ts", "",
            f'const a = new Pinecone({{ apiKey: "{PINECONE}" }});\n'
            f'const q = new QdrantClient({{ url: u, apiKey: "{VECTOR_KEY}" }}); '
            f'const r = new QdrantClient({{ apiKey: "{VECTOR_KEY}" }});\n'
            f"const w = weaviate.client({{ scheme: 'https', apiKey: '{VECTOR_KEY}' }});"),
    Planted("src/keys.js", "", f"const one = '{PINECONE}', two = '{PINECONE}';\n"
            "const p = new Pinecone({ apiKey: process.env.PINECONE_API_KEY });"),
    Planted("tools/web.py", "import requests",
            "r = requests.get(tool_input['url']); s = requests.post(url)\n"
            "t = requests.get('https://example.com/')\n"
            "page = urllib.request.urlopen(params.target).read()"),
    Planted("src/tools/proxy.cjs", "",
            "axios.get(params.endpoint); http.request(toolArgs.target)\nfetch('/static');"),
    Planted("src/tools/mcp-http.py", "", "requests.post(input.endpoint, json=body)"),
    Planted("config/agent_config.yml", "name: demo",
            "roots:\n  - '/etc'\n  - ~\n  - /home\nallow_paths: [\"./data\"]"),
    Planted("tools/paths.json", '{"allow_paths": ["./a", "C:\\"], "x": 1}',
            '{"roots": ["/Users"], "allowedDirectories": ["/srv/data"]}'),
    Planted("src/mcp/runner.js", "", 'const t = { "shell": true };\nexecSync(`git ${args.ref}`);'),
    Planted("config/mcp.json", "",
            '{\n  "env": {\n    "REGION": "eu",\n'
            f'    "API_KEY": "{GITHUB_ENV}"\n  }}\n}}'),
    Planted("config/mcp_settings.yaml", "servers:",
            f"  env:\n    API_TOKEN: '{GITHUB_ENV}'\n  other:\n    env:\n      PORT: 80"),
    Planted("src/mcp/registry.ts", "",
            "server.tool('a', { inputSchema: {} });\n"
            "server.tool('b', {\n  inputSchema: {\n    type: 'object'\n  }\n});"),
    Planted("src/mcp/admin_tool.py", "@mcp.tool()",
            "def purge(args):\n    shutil.rmtree(args.path)\n    os.remove(target)\n"
            "    db.execute('DROP TABLE users; TRUNCATE  TABLE logs')"),
    Planted("src/db/cleanup_tool.ts", "", "db.run('DROP TABLE tmp'); fs.unlinkSync(args.path);"),
    Planted("src/prompts/dev.ts", "",
            "const m = [ 'developer', `Rules: ${req.body.input}` ];\n"
            "const systemPrompt = `Hi ${user.name} and ${userQuery}`;\n"
            "const d = { content: `Use ${req.query.q}`, role: 'system' };"),
    Planted("agent/prompts.py", "",
            'system_prompt = f"""\nFollow: {raw_user_prompt}\n"""\n'
            "developer_prompt = f'''Be {status}'''\n"
            "m = SystemMessage(content=f\"Do {user_message}\")\n"
            "n = {'content': f'Say {query}', 'role': 'developer'}"),
    Planted("src/skip/fixtures.ts", "", "eval(aiOutput); fetch(args.url);"),
    Planted("src/blocked.ts", f"/* {PREFIX}-disable */\neval(aiOutput);\n/* {PREFIX}-enable */",
            f"eval(aiOutput);\n/* {PREFIX}-disable AIS-002 */\neval(msg);\nfetch(args.url);"),
    Planted("src/inline.ts", f"eval(aiOutput); // {PREFIX}-ignore: AIS-003",
            f"eval(msg); // {PREFIX}-ignore AIS-003\neval(msg); /* {PREFIX}-ignore:AIS-002 */\n"
            f"# {PREFIX}-ignore\neval(content)"),
    Planted("src/nextline.ts", f"// {PREFIX}-disable-next-line AIS-002\neval(aiOutput);",
            f"// {PREFIX}-disable-next-line AIS-001\neval(msg);\n"
            f"// {PREFIX}-disable-next-line\n/* {PREFIX}-disable AIS-007 */\neval(msg);\n"
            f"/* {PREFIX}-enable */ eval(result);"),
    Planted(".gitignore", "# generated\ndist/**\n  *.log \n", "docs/\n./tmp\n!keep.txt"),
    Planted(f".{PREFIX}ignore", "tests/\n\n#none", "vendor\n*.snap"),
    Planted("docs/guide.md", "", "We mention eval(output) and fetch(args.url) in prose only."),
    Planted("assets/logo.PNG", "", "eval(aiOutput)"),
)

PLANTED: tuple[Planted, ...] = tuple(Planted(c.file_path, "", c.code) for c in CASES) + _EXTRA

# Leading folders, by document: some are pruned or ignored, most are not.
FOLDERS = ("", "pkg/", "dist/", "", "web/vendor/", "", ".cache/", "", "tests/", "", "benchmark/")


@dataclass(frozen=True)
class Config:
    """Configuration files of a scan, (name, text) each, and the settings that they mean."""

    files: tuple[tuple[str, str], ...]
    disabled: tuple[str, ...] = ()
    severity_rule: str | None = None
    severity: str | None = None
    min_entropy: float | None = None
    threshold: str | None = None
    ignores: tuple[str, ...] = ()


_RC, _PLAIN, _LAST = f".{PREFIX}rc.json", f".{PREFIX}rc", f"{PREFIX}.config.json"
CONFIGS = (
    Config(()),
    Config(((_RC, '{"disabledRules": ["AIS-002", "SEC-001"], "failThreshold": "critical"}'),),
           disabled=("AIS-002", "SEC-001"), threshold="critical"),
    # broken, so the next one counts; the last is never looked at
    Config(((_RC, '{"disabledRules": ["AIS-003"'), (_PLAIN, '{"minEntropy": 4.5, "ignorePaths": ["pkg/**", "tools"]}'),
            (_LAST, '{"minEntropy": 1}')),
           min_entropy=4.5, ignores=("pkg", "tools")),
    Config(((_LAST, '{"severityOverrides": {"MCP-004": "info", "nothing": "low"}, "disabledRules": "AIS-002"}'),),
           severity_rule="MCP-004", severity="info"),
    # parsable but no object: nothing is set, and the next one is not looked at
    Config(((_RC, "3"), (_PLAIN, '{"disabledRules": ["AIS-002"]}'))),
    Config(((_PLAIN, '{"minEntropy": 2, "failThreshold": "info", "disabledRules": ["MCP-001", 7], "ignorePaths": null}'),),
           disabled=("MCP-001",), min_entropy=2.0, threshold="info"),
    Config(((_PLAIN, '{"minEntropy": "3", "failThreshold": "", "severityOverrides": null}'),)),
)
