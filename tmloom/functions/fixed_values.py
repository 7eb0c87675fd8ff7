"""Fixed values.

Sizes, thresholds, labels and prompt wordings that must be equal to the ones
existing users of the two translation chains rely on.  They are plain data;
every function that uses one also takes it as a parameter.
"""

# --- line chain -----------------------------------------------------------
FAILURE_MARK = "[[TRANSLATION_FAILED]]"
LINE_BATCH_SIZE = 25
LINE_MAX_ATTEMPTS = 3
POSTINGS_PER_TOKEN = 20
MIN_SIMILARITY = 0.1
DUPLICATE_SIMILARITY = 0.8
MAX_HINTS_PER_BATCH = 50
SOURCE_LANG = "zh"
TARGET_LANG = "en"

LINE_INSTRUCTION = """
你是一个专业的工业自动化与机械制造领域的翻译专家。
任务：将给定的【物料描述】从中文翻译成英文。

核心规则：
1. 【领域适配】使用工业、机械、电子元件的标准英文术语（如：Socket, Cylinder, Relay, Valve）。
2. 【保留参数】绝对禁止修改任何型号、规格、尺寸、数字符号。
   - 例如：'3×6mm2', 'Φ40', 'AC220V', 'YJV', 'S18009-2503' 等必须原样保留。
3. 【品牌处理】知名品牌请使用官方英文名（如：施耐德 -> Schneider, 亚德客 -> AirTAC），未知品牌保留原文或拼音。
4. 【格式一致】保持与原文行数一一对应，不要合并或拆分行。
"""

VERIFY_HEAD = (
    "请校验以下【原文列表】与【译文列表】是否内容对应，且行数一致。\n"
    "如果完全对应，请仅回复 YES。如果不对应或有错位，请回复 NO。\n\n"
)
VERIFY_SOURCE_LABEL = "【原文列表】:\n"
VERIFY_TARGET_LABEL = "【译文列表】:\n"

# --- scoring --------------------------------------------------------------
SCORE_BATCH_SIZE = 10
SCORE_MAX_ATTEMPTS = 10
SCORE_RETRY_PAUSE_SECONDS = 2.0
LINE_RETRY_PAUSE_SECONDS = 1.0
FAILED_SCORE = "-1"
SCORE_SYSTEM = "You are a helpful assistant for evaluating translation quality."
SCORE_RUBRIC_HEAD = """
# Role
你是一位资深的工业与机械工程翻译评估专家。

# Task
请对以下每一行中英文翻译进行质量打分（范围 0-10）。

# Scoring Standards
1. **核对参数（最重要）**：检查型号、规格、数字（如 `YJV`, `3×6mm2`, `E160233`）是否与原文**严格一致**。
   - 如果参数/数字有误，直接打 **0分**。
2. **术语准确性**：
   - **10分**：术语地道，参数完全一致。
   - **8-9分**：意思准确，参数无误，但英文表达略显生硬。
   - **6-7分**：核心意思对，但术语不够专业。
   - **0-5分**：关键术语错误或漏译。

# Output Constraints
- **仅输出数字**（例如：`10`）。
- **不要**加任何文字、标点、前缀（不要写 "Score:"）或解释。
- 必须保持一行对应一个分数，顺序与输入严格一致。
- 输出行数必须与输入行数一致。

# Input Data
"""
SCORE_RUBRIC_TAIL = "\n"

# --- document chain -------------------------------------------------------
PRIMARY_BACKEND = "pdfplumber"
FALLBACK_BACKEND = "PyPDF2"
CHUNK_MAX_CHARS = 1800
BLOCK_MAX_ATTEMPTS = 4
RPM_LIMIT = 4800
RETRY_BASE_DELAY = 2.0
RATE_LIMIT_DELAY_CAP = 15.0
ERROR_DELAY_CAP = 8.0
HINTS_PER_BLOCK = 8
HEADING_MAX_CHARS = 120
NOISE_MAX_WORDS = 8
EXAMPLE_CHARS = 180
SUSPICIOUS_LISTED = 20

BLOCK_SYSTEM = (
    "你是一名严谨的学术译者和术语整理助手。"
    "你的任务是把英文技术或学术文本译成自然、准确、完整的中文，并抽取英中术语。"
    "不要遗漏内容，不要添加解释，不要输出思考过程。"
    "保留原文中的编号、年份、人名、引文、括号、章节号等关键信息。"
    "输出必须是 JSON 对象，格式如下："
    '{"translation":"中文译文","terms":[{"source":"英文术语","target":"中文术语"}]}。'
    "terms 最多保留 8 项，只保留真正有价值的术语。"
)
BLOCK_ID_LABEL = "块编号："
BLOCK_PAGE_LABEL = "页码："
BLOCK_ASK = "请翻译下面的英文文本，并抽取术语：\n"
BLOCK_HINTS_HEAD = "\n优先术语参考：\n"
BLOCK_HINTS_TAIL = "\n如果原文出现这些术语，请优先沿用对应中文译法，保持前后一致。"

# --- report labels --------------------------------------------------------
DOCUMENT_TITLE_SUFFIX = " 中文译文"
PAGE_HEADING_PREFIX = "第 "
PAGE_HEADING_SUFFIX = " 页"
FAILED_BLOCK_PREFIX = "[翻译失败] "
REVIEW_TITLE = "# 自检报告"
REVIEW_TOTAL = "- 总块数："
REVIEW_OK = "- 成功块数："
REVIEW_FAILED = "- 失败块数："
REVIEW_SUSPICIOUS = "- 中文占比可疑块数："
REVIEW_FAILED_HEADING = "## 失败块"
REVIEW_SUSPICIOUS_HEADING = "## 中文占比可疑块"
REVIEW_NONE = "- 无"
UNKNOWN_ERROR = "unknown error"

EXTRACTION_COLUMNS = (
    "Page", "Block ID", "Source Text", "Word Count", "Character Count",
    "Extraction Backend", "Skipped Pages",
)
BILINGUAL_COLUMNS = (
    "Page", "Block ID", "Source Text", "Chinese Translation", "Status",
    "Cache Hit", "Attempts", "Elapsed Seconds", "Error Message",
)
GLOSSARY_COLUMNS = ("English Term", "Chinese Term", "Frequency", "Pages", "Example")
SCORED_COLUMNS = ("Source", "Target", "Score")
