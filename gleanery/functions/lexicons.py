"""Default rule tables.  Every operator takes its rules as parameters; these are what it takes if none are given."""

from __future__ import annotations

from gleanery.functions.rules import Rule

# Fixed values from here on: patterns, labels and weights that decide results.

TOPICS = [
    Rule("session-failure", r"\b(cross[- ]session|session (?:drop|lost|resume|failure)|fails to load sessions|silently dropped|approval.{0,24}never)\b"),
    Rule("mcp-runtime", r"\b(mcp[- ]server|fails? to start|incompatible mcp|initialize method|stdio mcp|fetch drops|mcp version)\b"),
    Rule("tool-calling", r"function_call|\b(tool call(?:ing)?|tool use|calltool|tools? fail|empty list|tool output|unknown mcp tool)\b"),
    Rule("reliability-transport", r"\b(timeout|disconnect|reconnect|streamable|sse|hang|crash|eof|retry budget)\b"),
    Rule("memory-context", r"\b(memory|context window|token|compaction|preamble|truncat)\b"),
    Rule("auth-security", r"\b(oauth|www-authenticate|sandbox|permission|wipe|recursive delete)\b"),
    Rule("install-platform", r"\b(install|windows|wsl|path|npm|pip |uv |brew)\b"),
    Rule("workflow-skills", r"\b(skill|agents\.md|claude\.md|hook|harness|workflow)\b"),
]
PRODUCTS = [
    Rule("mcp", r"\bmcp\b|model context protocol"),
    Rule("claude-code", r"\bclaude code\b|\bclaude\.md\b"),
    Rule("cline", r"\bcline\b"),
    Rule("opencode", r"\bopencode\b"),
    Rule("vercel-ai", r"\bai sdk\b|\bvercel/ai\b|@ai-sdk\b"),
    Rule("openai-api", r"\bopenai\b.{0,24}\b(api|sdk|responses)\b"),
]
REPOSITORY_PRODUCTS = {
    "modelcontextprotocol/servers": "mcp", "modelcontextprotocol/python-sdk": "mcp", "modelcontextprotocol/typescript-sdk": "mcp", "anthropics/claude-code": "claude-code",
    "openai/openai-python": "openai-api", "cline/cline": "cline", "anomalyco/opencode": "opencode", "vercel/ai": "vercel-ai",
}
FINDING_TYPES = {
    "BACKLASH": r"\b(dead|abandon|boycott|never using|moving away|worse to work with)\b",
    "MIGRATION": r"\b(migrat|switch(?:ing)? from|replaced .+ with)\b",
    "UNEXPECTED_USE": r"\b(unexpected|not how .{0,40}positioned|users? expect)\b",
}
EXCLUSIONS = {
    "spam": r"\b(as an ai|i am an ai|generated by|agent-coordination|ci alert|hourly routine|awos automated)\b",
    "show": r"^show hn\b",
    "job": r"\b(hiring|job|we're hiring|who is hiring)\b",
    "benchmark": r"\b(benchmark|lmsys|leaderboard|arena elo)\b",
    "repost": r"\b(introducing |announcing |qwen 3\.8|glm-5\.3|frontier (?:coding|model))\b",
    "media": r"\b(techcrunch|the verge|mit technology review)\b",
    "beginner": r"\b(how do i|getting started|what is mcp|beginner)\b",
    "one_install": r"\b(windows: server fails to start when node\.js installed|left cli missing from path)\b",
    "install": r"\b(install|path|npm i|brew install)\b",
    "install_context": r"\b(mcp|tool|session|stream)\b",
    "opinion": r"\b(feel worse|is dead|is amazing|hot take)\b",
    "banned": r"\b(banned from claude|i was banned)\b",
    "claim": r"\b(99\.9%|fail the .{0,40}spec check)\b",
    "stars": r"\b\d[\d,.]*k?\s*stars\b",
    "no_repro": r"\bno repro\b",
    "repro": r"\b(repro|steps to reproduce|mcp-server|tool call|session)\b",
}
ARTIFACTS = [
    r"\b(repro|steps to reproduce|traceback|stack trace|expected behavior|actual behavior)\b",
    r"```",
    r"\b(mcp\.json|claude\.md|agents\.md|\.cursor/mcp|stdio|function_call|calltoolresult|streamable http|session_id)\b",
    r"\b(fails? to start|silently dropped|retry budget|unknown mcp tool|tool output.{0,24}truncat)\b",
]
FEATURE_REQUEST_TITLE = r"^\s*(feat(ure)?\b|\[feature\]|enhancement\b)"
FEATURE_REQUEST = r"\b(feature request|please add support|add support for)\b"
EXPERIENCE_CUES = [
    Rule("Agent memory", r"\b(long[- ]term memory|memory-centric|multi[- ]session dialogues?)\b"),
    Rule("Video", r"\b(video editing|open[- ]ended video)\b"),
    Rule("Voice", r"\b(long[- ]form speech|multiple speakers|speech synthes(?:is|ize)|multi[- ]speaker)\b"),
    Rule("Multimodal", r"\b(audio[- ]visual|audiovisual|temporally synchronized)\b"),
    Rule("Agents", r"\b(person[- ]grounded|human expertise|expert (?:knowledge|traces)|ai skill generation)\b"),
    Rule("HCI", r"\b(people with disabilit|social virtual reality|ableist|protection mechanisms?|co[- ]design(?:ed|ing)?)\b"),
    Rule("Eval", r"\b(simulated[- ]user|persona agents?|digital products)\b"),
]
PAPERS = {
    "theory": r"\b(calibration dimension|convex calibration|jaccard measure|m[oö]bius inversion|vc class(?:es)?|sample complexity|hypothesis class|brier score|online boosting|weak-to-strong|rademacher|pac[- ]learn|generalization bound|learning theory|affine dimension|minhash gram)\b",
    "users": r"\b(users?|people with|disabilit(?:y|ies)|digital products?|interface|multi[- ]session|conversation(?:s|al)?|video editing|speech|voice|avatar|protection mechanisms?)\b",
    "infra": r"\b(speculative decoding|draft tokens?|draft trees?|kv cache|serving stack|inference accelerat|losslessly accelerat|kernel fusion)\b",
    "small_model": r"\b(1[- ]?billion[- ]parameter|1b parameters?|trained from scratch|permissible post-training|pretraining corpus|pedagogically controlled)\b",
    "benchmark_title": r"bench",
    "benchmark": r"\bwe (?:introduce|present|propose)\b[\s\S]{0,80}\bbenchmark\b",
    "implication": r"\b(production[- ]ready|digital products?|multi[- ]session|people with disabilit|protection mechanisms?|real[- ]time.{0,48}editing|long[- ]form speech|synchronized audiovisual|human expertise|simulated[- ]user|testing AI systems and digital products)\b",
    "researchers_only": r"\b(ai scientists?|research workflows?|hypothesis generation|manuscript preparation|pretraining corpus|formally verified|machine[- ]checked|meta[- ]harness|harness system|world models?|aaa games)\b",
    "ai_context": r"\b(ai|artificial intelligence|llm|language model|foundation model|machine learning|neural|multimodal|agentic|human[- ]ai|robot)\b",
    "hci_words": r"\b(interaction|interface|user experience|assistant|copilot|chatbot|co[- ]design)\b",
}
TAXONOMY = [
    Rule("agents", r"\b(agentic(?:\s+workflow)?|tool use|computer use|multi[- ]agent|long[- ]term memory|memory-centric|planning loop|gui agent)\b"),
    Rule("human-ai-interaction", r"\b(human[- ]ai interaction|ai assistant|conversational interface|human[- ]ai collaboration|personalization)\b"),
    Rule("generative-ui", r"\b(generative ui|generative user interface|ui generation)\b"),
    Rule("multimodal", r"\b(vision[- ]language|multimodal|voice interface|speech (?:generation|synthesis)|image generation|video generation|audio[- ]visual|audiovisual)\b"),
    Rule("trust-eval", r"\b(hallucination|uncertainty|explainability|ai safety|red[- ]teaming|trustworthy ai)\b"),
    Rule("embodied", r"\b(embodied ai|human[- ]robot interaction|\bhri\b|spatial interaction|wearable ai)\b"),
]
BACKGROUND = [
    Rule("training", r"\b(model training|post[- ]training|fine[- ]tuning|pretraining)\b"),
    Rule("rl", r"\b(reinforcement learning|\brlhf\b|\bppo\b)\b"),
    Rule("distillation", r"\b(distillation|knowledge distillation)\b"),
    Rule("inference", r"\b(inference|speculative decoding|serving)\b"),
    Rule("architecture", r"\b(architecture|transformer|mixture[- ]of[- ]experts)\b"),
]
CAPABILITIES = [
    Rule("tool-calling", r"function_call|tool[- ]call(?:ing)?|\btool use\b|\bcalltool\b"),
    Rule("session-state", r"session[- ](?:state|failure|drop|lost|resume)|cross[- ]session|session state is dropping"),
    Rule("onboarding", r"install[- ]platform|install and platform setup|\binstall\b.{0,48}\b(setup|platform|windows|wsl|npm|pip|uv |brew)\b"),
    Rule("mcp", r"\bmcp\b|model context protocol"),
    Rule("agent-skills", r"workflow-skills|colleague\.skill|\bskills?\b.{0,32}(packag|workflow|claude\.md|agents\.md)"),
    Rule("persistent-memory", r"long[- ]term memory|persistent memory|lycheememory|\b1m context\b|context cach|persisted reasoning|memory-context|memory and context overhead"),
    Rule("multimodal-agent", r"visual agentic|native multimodality|audio[- ]visual|multimodal agent"),
    Rule("voice", r"\btts\b|voice (?:think|model|agent|fast)|speech synthes|gpt[- ]realtime"),
    Rule("generative-ui", r"generative ui|generative user interface"),
    Rule("coding-agent", r"visual agentic|coding agents?|agentic coding|& agent\b|\bagent:\b|vibe gets to work|build mode|github copilot|frontier coding|claude code|claude-code|\bcline\b|\bopencode\b|multi[- ]language programming|real[- ]world productivity"),
]
JOIN_GROUPS = [  # group_id, keys, required keys, role
    ("coding-agent-onboarding", ["coding-agent", "onboarding"], ["onboarding"], None),
    ("tool-calling", ["tool-calling"], ["tool-calling"], None),
    ("session-memory", ["session-state", "persistent-memory"], ["session-state"], None),
    ("coding-agent-convergence", ["coding-agent"], ["coding-agent"], "SUPPLY"),
    ("persistent-memory", ["persistent-memory"], ["persistent-memory"], None),
    ("multimodal-agent", ["multimodal-agent"], ["multimodal-agent"], None),
    ("mcp-runtime", ["mcp"], ["mcp"], None),
    ("agent-skills", ["agent-skills"], ["agent-skills"], None),
    ("voice", ["voice"], ["voice"], None),
    ("generative-ui", ["generative-ui"], ["generative-ui"], None),
]
FRICTION_KEYS = ["onboarding", "tool-calling", "session-state", "mcp"]
LAUNCH_CUES = {
    "excluded": r"\b(hiring|job opening|join our team|webinar|conference|event|summit|campaign|opinion|essay|interview|podcast|grant|scholarship|partnership|partner(?:ing|ed)? with|investment|acquisition|case study|customer story|our position on|policy proposal|safety update|educators?|students|classroom|curriculum)\b",
    "minor": r"\b(minor (?:update|release|change)|patch release|bug ?fix(?:es)?|documentation update|maintenance (?:update|release)|small update|quality-of-life)\b",
    "release": r"\b(introduc(?:e|es|ed|ing)|announc(?:e|es|ed|ing)|launch(?:es|ed|ing)?|releas(?:e|es|ed|ing)|now available|generally available|\bga\b|open[- ]?weights|open[- ]?source|roll(?:ing)? out)\b",
    "availability": r"\b(available(?:\s+(?:today|now|to|on|in|for|via))?|api access|api\b|full weights|download(?:able)?|try it|access(?:ible)?|developers can|customers can|users can|all plans|shipping|shipped|released?|launched?|roll(?:ing)? out)\b",
}
EVENT_TYPES = [
    Rule("open-source-release", r"\b(open[- ]?weights|open[- ]?source|full weights)\b"),
    Rule("api-release", r"\b(api|sdk|developer platform)\b"),
    Rule("model-release", r"\b(model|gpt|claude|gemini|gemma|llama|grok|qwen|mistral|mixtral|deepseek|inkling|sonnet|opus|haiku)\b"),
    Rule("major-update", r"\b(update|upgrade|new (?:mode|feature|capability))\b"),
]
SOURCE_WEIGHTS = {
    "arXiv": 8.0, "OpenAI": 14.0, "Anthropic": 12.0, "Google DeepMind": 12.0, "Meta AI": 12.0, "xAI": 12.0, "DeepSeek": 13.0, "Qwen": 12.0, "Mistral AI": 12.0, "Kimi": 13.0, "MiniMax": 12.0, "Prime Intellect": 11.0,
    "ByteDance": 12.0, "Black Forest Labs": 11.0, "Thinking Machines": 11.0, "Hugging Face": 10.0, "Tech Blog": 7.0, "Foreign Media": 9.0, "Embodied AI": 9.0, "机器之心": 9.0, "新智元": 9.0, "量子位": 9.0,
    "Product Hunt": 8.0, "Developer Community": 8.0, "GitHub · Articles": 9.0, "GitHub · Skills": 10.0, "GitHub · Projects": 9.0,
}
LAUNCH_MODELS = r"\b(gpt[-\s]?\d|claude|gemini|grok|llama|qwen|deepseek|minimax|mistral|kimi)\b"
PLAIN_TAGS = ["live", "developer-community", "friction", "adoption", "workflow-shift", "migration", "unexpected-use"]  # tags that name no product
PLAIN_TAG_PREFIX = "evidence:"
TAGGED_TOPICS = ["mcp-runtime", "session-failure", "tool-calling", "install-platform"]
ADOPTION_TOPICS = [Rule("mcp", r"\bmcp\b"), Rule("session", r"\bsession\b"), Rule("tool-calling", r"\btool call"), Rule("install", r"\binstall\b")]
PAPER_TOPICS = [
    Rule("memory", r"\bmemory\b"), Rule("skill", r"\bskill\b"), Rule("hci", r"\bhci\b|harassment|safety vs"), Rule("video", r"\bvideo\b"), Rule("voice", r"\bvoice\b"), Rule("agents", r"\bagent\b"),
]
VALUE_CUES = {"SUPPLY": "High Impact", "CAPABILITY": "New Capability", "ADOPTION": "Developer Signal"}
EVIDENCE_ROLES = {"SUPPLY": "Launch", "CAPABILITY": "Research"}
OTHER_EVIDENCE_ROLE = "In the wild"
REASON_STATUSES = {"outside-window": "outside-window", "duplicate": "duplicate", "capped": "capped"}
OTHER_REASON_STATUS = "rejected"
SOURCE_GROUPS = {
    "labs": ["OpenAI", "Anthropic", "Google DeepMind", "Meta AI", "xAI", "DeepSeek", "Qwen", "Mistral AI", "Kimi", "MiniMax", "Prime Intellect", "ByteDance", "Black Forest Labs", "Thinking Machines"],
    "research": ["arXiv", "Hugging Face"],
}
OTHER_SOURCE_GROUP = "community"
