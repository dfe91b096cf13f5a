"""Column layouts of the tables the operators read and write."""

DOCS = (
    "repo_id string, doc_ord bigint, file_path string, type string, is_code boolean, "
    "is_implementation boolean, title string, token_count int, text string"
)
CHUNKS = DOCS + ", chunk_no int, chunk_id string, vector array<float>, embed_error string"
MESSAGES = "conv_id string, turn int, role string, content string"
TURNS = "conv_id string, turn_no int, user_text string, assistant_text string"
WIKI_PAGES = (
    "wiki_id string, page_ord int, page_id string, title string, content string, "
    "file_paths array<string>, importance string, related_pages array<string>, parent_id string"
)
WIKI_SECTIONS = (
    "wiki_id string, sec_ord int, section_id string, title string, pages array<string>, "
    "subsections array<string>"
)
PROJECTS = (
    "id string, owner string, repo string, name string, repo_type string, submittedAt bigint, language string"
)
REPOS = "owner string, repo string, type string, local_path string, repo_url string"
FILTER_RULES = "repo_id string, kind string, pattern string"
LISTING = "repo_id string, page_no int, payload string"
SSE_LINES = "req_id string, seq bigint, line string"

# Shapes of generated wiki XML; both nested and flat placements of repeated elements are accepted.
_PAGE_XML = (
    "array<struct<_id: string, title: string, description: string, importance: string, "
    "relevant_files: struct<file_path: array<string>>, file_path: array<string>, "
    "related_pages: struct<related: array<string>>, related: array<string>, parent_section: string>>"
)
_SECTION_XML = (
    "array<struct<_id: string, title: string, pages: struct<page_ref: array<string>>, "
    "page_ref: array<string>, subsections: struct<section_ref: array<string>>, "
    "section_ref: array<string>>>"
)
WIKI_XML = (
    "title string, description string, "
    f"sections struct<section: {_SECTION_XML}>, section {_SECTION_XML}, "
    f"pages struct<page: {_PAGE_XML}>, page {_PAGE_XML}, _corrupt_record string"
)

# A cached wiki file: structure, generated pages by id, repository.
_STORED_PAGE = "id: string, title: string, content: string, filePaths: array<string>, importance: string, relatedPages: array<string>"
WIKI_FILE = (
    "wiki_structure struct<id: string, title: string, description: string, "
    f"pages: array<struct<{_STORED_PAGE}>>, "
    "sections: array<struct<id: string, title: string, pages: array<string>, subsections: array<string>>>, rootSections: array<string>>, "
    f"generated_pages map<string, struct<{_STORED_PAGE}>>, repo_url string, "
    "repo struct<owner: string, repo: string, type: string, localPath: string, repoUrl: string>, provider string, model string, malformed string"
)
