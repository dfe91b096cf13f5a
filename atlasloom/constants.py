"""Lists, formats and wording that results depend on, kept as plain text in one place."""

# --- fixed values: file suffixes (code first, then documents) -------------------------------
CODE_SUFFIXES = (
    ".py", ".js", ".ts", ".java", ".cpp", ".c", ".h", ".hpp", ".go", ".rs",
    ".jsx", ".tsx", ".html", ".css", ".php", ".swift", ".cs",
)
DOC_SUFFIXES = (".md", ".txt", ".rst", ".json", ".yaml", ".yml")

# --- fixed values: default exclusion rules --------------------------------------------------
EXCLUDED_DIRS = (
    "./.venv/", "./venv/", "./env/", "./virtualenv/",
    "./node_modules/", "./bower_components/", "./jspm_packages/",
    "./.git/", "./.svn/", "./.hg/", "./.bzr/",
    "./__pycache__/", "./.pytest_cache/", "./.mypy_cache/", "./.ruff_cache/", "./.coverage/",
    "./dist/", "./build/", "./out/", "./target/", "./bin/", "./obj/",
    "./docs/", "./_docs/", "./site-docs/", "./_site/",
    "./.idea/", "./.vscode/", "./.vs/", "./.eclipse/", "./.settings/",
    "./logs/", "./log/", "./tmp/", "./temp/",
)
EXCLUDED_FILES = (
    "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "poetry.lock",
    "Pipfile.lock", "requirements.txt.lock", "Cargo.lock", "composer.lock",
    ".lock", ".DS_Store", "Thumbs.db", "desktop.ini", "*.lnk", ".env",
    ".env.*", "*.env", "*.cfg", "*.ini", ".flaskenv", ".gitignore",
    ".gitattributes", ".gitmodules", ".github", ".gitlab-ci.yml",
    ".prettierrc", ".eslintrc", ".eslintignore", ".stylelintrc",
    ".editorconfig", ".jshintrc", ".pylintrc", ".flake8", "mypy.ini",
    "pyproject.toml", "tsconfig.json", "webpack.config.js", "babel.config.js",
    "rollup.config.js", "jest.config.js", "karma.conf.js", "vite.config.js",
    "next.config.js", "*.min.js", "*.min.css", "*.bundle.js", "*.bundle.css",
    "*.map", "*.gz", "*.zip", "*.tar", "*.tgz", "*.rar", "*.7z", "*.iso",
    "*.dmg", "*.img", "*.msix", "*.appx", "*.appxbundle", "*.xap", "*.ipa",
    "*.deb", "*.rpm", "*.msi", "*.exe", "*.dll", "*.so", "*.dylib", "*.o",
    "*.obj", "*.jar", "*.war", "*.ear", "*.jsm", "*.class", "*.pyc", "*.pyd",
    "*.pyo", "__pycache__", "*.a", "*.lib", "*.lo", "*.la", "*.slo", "*.dSYM",
    "*.egg", "*.egg-info", "*.dist-info", "*.eggs", "node_modules",
    "bower_components", "jspm_packages", "lib-cov", "coverage", "htmlcov",
    ".nyc_output", ".tox", "dist", "build", "bld", "out", "bin", "target",
    "packages/*/dist", "packages/*/build", ".output",
)
TREE_SKIPPED_DIRS = ("__pycache__", "node_modules", ".venv")
TREE_SKIPPED_FILES = ("__init__.py", ".DS_Store")

# --- fixed values: limits -------------------------------------------------------------------
DOC_TOKEN_LIMIT = 8192
CODE_TOKEN_LIMIT = 81920
REQUEST_TOKEN_LIMIT = 8000
CHUNK_WORDS = 350
CHUNK_OVERLAP = 100
TOP_K = 20
DECK_CHAR_LIMIT = 30000
MAX_RESEARCH_ITERATIONS = 5
EMBED_BATCH_SIZES = {"default": 500, "google": 100, "bedrock": 100, "dashscope": 25}

# --- fixed values: languages ----------------------------------------------------------------
DEFAULT_LANGUAGE = "en"
LANGUAGES = {
    "en": "English",
    "ja": "Japanese (日本語)",
    "zh": "Mandarin Chinese (中文)",
    "zh-tw": "Traditional Chinese (繁體中文)",
    "es": "Spanish (Español)",
    "kr": "Korean (한국어)",
    "vi": "Vietnamese (Tiếng Việt)",
    "pt-br": "Brazilian Portuguese (Português Brasileiro)",
    "fr": "Français (French)",
    "ru": "Русский (Russian)",
}

# --- fixed values: page categories (ordinal order; id, section title, keywords) --------------
CATEGORIES = (
    ("overview", "Overview", ("overview", "introduction", "about")),
    ("architecture", "Architecture", ("architecture", "structure", "design", "system")),
    ("features", "Core Features", ("feature", "functionality", "core")),
    ("components", "Components", ("component", "module", "widget")),
    ("api", "API", ("api", "endpoint", "service", "server")),
    ("data", "Data Flow", ("data", "flow", "pipeline", "storage")),
    ("models", "Models", ("model", "ai", "ml", "integration")),
    ("ui", "User Interface", ("ui", "interface", "frontend", "page")),
    ("setup", "Setup & Configuration", ("setup", "config", "installation", "deploy")),
)
OTHER_CATEGORY = ("other", "Other")
IMPORTANCE_SECTIONS = (
    ("high", "section-high", "Core Components"),
    ("medium", "section-medium", "Key Features"),
    ("low", "section-low", "Additional Information"),
)

# --- fixed values: text formats -------------------------------------------------------------
REDACTED = "***TOKEN***"
CONTEXT_RULE = "\n\n----------"
UNKNOWN_FILE = "unknown"
CONTENT_MISSING = "Content not generated"
CONTENT_PENDING = "Loading..."
NO_SUMMARY = "No summary available"
RESEARCH_TAG = "[DEEP RESEARCH]"
NO_RETRIEVAL_NOTE = "<note>Answering without retrieval augmentation.</note>\n\n"
SIZE_LIMIT_NOTE = (
    "<note>Answering without retrieval augmentation due to input size constraints.</note>\n\n"
)
TOKEN_LIMIT_ERRORS = ("maximum context length", "token limit", "too many tokens")
NO_MESSAGES_ERROR = "Error: No messages provided"
NOT_FROM_USER_ERROR = "Error: Last message must be from the user"
NO_XML_ERROR = "No valid XML found in response"
NO_VALID_TEXT_ERROR = "No valid texts found after filtering"

# --- fixed values: research response markers ------------------------------------------------
FINAL_MARKER = "## Final Conclusion"
PLAN_MARKER = "## Research Plan"
UPDATE_MARKER = "## Research Update "
CLOSING_HEADERS = ("## Conclusion", "## Summary")
CONTINUING_PHRASES = ("I will now proceed to", "Next Steps", "next iteration")
COMPLETION_PHRASES = (
    "This concludes our research",
    "This completes our investigation",
    "This concludes the deep research process",
    "Key Findings and Implementation Details",
    "In conclusion,",
)
FORCED_CONCLUSION = (
    "\n\n## Final Conclusion\nAfter multiple iterations of deep research, we've gathered significant "
    "insights about this topic. This concludes our investigation process, having reached the maximum "
    "number of research iterations. The findings presented across all iterations collectively form our "
    "comprehensive answer to the original question."
)

# --- fixed values: decks and workshops ------------------------------------------------------
DEFAULT_SLIDES = (
    "Title Slide: Introduction to {repo}",
    "Overview: Key features and purpose of {repo}",
    "Architecture: System components and structure",
    "Features: Main capabilities and functionalities",
    "Implementation: How it works and technical details",
    "Use Cases: How to use {repo} effectively",
    "Conclusion: Summary and next steps",
)
NOTE_DIV = '<div style="text-align: right; font-size: 0.85em; color: #666;">\n'
FINAL_PROJECT_NOTE = (
    NOTE_DIV + "Estimated time: 20-30 minutes | Combines concepts from all exercises\n</div>\n\n"
)
