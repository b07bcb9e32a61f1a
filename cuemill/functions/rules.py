"""Word lists, patterns, constants and labels the results depend on. Values only."""

# --- characters -------------------------------------------------------------------------------
FILLER_CHARS = "嗯啊呃额哦噢诶唉"
STRIPPABLE = " \t\r\n，。！？；：、,.!?;:…“”‘’\"'"
SENTENCE_PUNCTUATION = "，。！？；：、,.!?;:"
DISPLAY_PUNCTUATION = "，。！？；：、,.!?;:…“”‘’"
SENTENCE_ENDS = "。！？!?"
UNIT_BAD_STARTS = ["的", "得", "地", "了", "着", "过", "吗", "呢", "吧", "呀", "和", "与", "及", "或"]
UNIT_BAD_ENDS = ["把", "被", "在", "对", "给", "向", "从", "为", "和", "与", "及", "或"]

# --- token patterns (Java regex) ----------------------------------------------------------------
CJK = r"[㐀-䶿一-鿿]"
ASCII_TOKEN = r"[A-Za-z0-9]+(?:[+.#_-][A-Za-z0-9]+)*"
ASCII_WORD = r"^[A-Za-z0-9][A-Za-z0-9+.#_-]*$"
LATIN_WORD = r"^[A-Za-z][A-Za-z0-9+.#_-]*$"
PROTECTED_TEXT = r"[A-Za-z0-9]"
AGE_WORDS = r"刚刚|\d+分钟前|\d+小时前|昨天|前天|\d+天前|\d+周前|\d+月前|\d+年前"
COUNT_LINE = r"^(\d+(?:\.\d+)?万?|\d+)$"
USER_LINK_LINE = r"^\[([^\]]+)\]\(//www\.douyin\.com/user/"
MISSING_TEXT = "素材不足"

# --- rhythm -------------------------------------------------------------------------------------
MIN_SYLLABLES = 8
MIN_SPAN_MS = 4000
MIN_WORD_MS = 20
PREFERRED_CUE_MS = 3800
ADAPTIVE_CUE_MS = 5500
PAUSE_LIMIT_MS = 450
PAUSE_TARGET_MS = 240
PAUSE_MIN_REMOVAL_MS = 40
EPS_US = 500
SPEED_TIERS = [(2.4, 112), (2.7, 108), (3.0, 105)]  # units per second below -> speed in percent

# --- speech regions and boundaries ------------------------------------------------------------
ENTER_THRESHOLD = 0.50
EXIT_THRESHOLD = 0.35
EXIT_RUN = 2
FRAME_DB_FLOOR = -96.0
NOISE_RANK = 0.20
NOISE_MARGIN_DB = 11.0
NOISE_MIN_DB = -44.0
NOISE_MAX_DB = -30.0
ONSET_WINDOWS_US = {"opening": (-300_000, 600_000), "after-filler": (-120_000, 600_000), "normal": (-80_000, 450_000)}
ONSET_AFTER_PREDECESSOR_US = 40_000
ONSET_REACH_US = 40_000

FRAME_US = 10_000
HEADROOM_US = {"opening": 32_000, "after-filler": 30_000, "normal": 55_000}
HEADROOM_LIMIT_US = {"opening": 60_000, "after-filler": 60_000, "normal": 90_000}
MIN_HEADROOM_US = 20_000
FILLER_REACH_US = 900_000
SPLICE_GAP_US = (-20_000, 12_000)
SPLICE_PREROLL_US, SPLICE_POSTROLL_US = 4_000, 2_000
SPLICE_FADE_MS, FADE_MS = 4, 8
MIN_TAIL_US, TARGET_TAIL_US, MAX_TAIL_US = 20_000, 100_000, 350_000
QUIET_RUN_FRAMES = 2

# --- audits -------------------------------------------------------------------------------------
OVERLAP_TOLERANCE_MS = 20
MEDIA_TOLERANCE_MS = 250
SUBTITLE_TOLERANCE_MS = 21
MIN_SEGMENT_MS = 250
START_MARGIN_MS = (20, 90)
END_MARGIN_MS = (20, 350)
SPLICE_MARGIN_MS = (-2, 4)
MAX_HEADROOM_MS = {"opening": 60, "after-filler": 60, "normal": 90}
ENTRY_STRATEGIES = ["silero-speech-onset", "energy-trough-near-asr", "continuous-speech-zero-cross-splice"]
PARTIAL_ENTRY = ["silero-speech-onset", "continuous-speech-zero-cross-splice"]
SPLICE_ENTRY = "continuous-speech-zero-cross-splice"
ONSET_ENTRY = "silero-speech-onset"
MAX_UNIT_WIDTH = 18.0
ENTRY_MS = {"state": 220, "item": 150, "formula-part": 150}
READABLE_HOLD_MS = {"state": 1000, "item": 750, "formula-part": 600}
BOUNDARY_REASONS = ["sentence", "clause", "breath-group"]

# --- labels -------------------------------------------------------------------------------------
HOOK_RULES = [
    ("反常识 / 纠偏", r"不是|别再|很多人|误区|错了|以为"),
    ("问题悬念", r"为什么|怎么|如何|吗|？|\?"),
    ("结果前置", r"(?i)\d|万|元|offer|结果|拿到|做到|涨"),
    ("身份召唤", r"你|普通人|新手|老板|打工人|求职|博主"),
]
HOOK_DEFAULT = "痛点直戳"
SEGMENT_RULES = [
    ("大原则", r"三条|大原则"),
    ("方法拆解", r"五个标准|第一个标准|第二个标准|第三个标准|第四个标准|第五个标准"),
    ("反常识归因", r"心理问题|不愿意|恐惧|自恋|借口"),
    ("案例解释", r"举例|比如|像我|案例"),
]
SEGMENT_FIRST, SEGMENT_LAST = "Hook / 结果问题", "收束 / 行动"
SEGMENT_EARLY, SEGMENT_MIDDLE, SEGMENT_DEFAULT = "场景/痛点", "方法/案例", "执行要求"
BUCKET_LABELS = ["0-3s", "3-8s", "8-20s", "20-45s", "45s+"]
BUCKET_FUNCTIONS = ["Hook", "场景/痛点", "冲突升级", "方法/案例", "CTA/收束"]
AUDIENCE_RULES = [
    ("求职/职业转型人群", r"(?i)求职|offer|面试|简历|应届|实习"),
    ("想提升商业化能力的人", r"赚钱|商业|副业|老板|生意|变现"),
    ("内容创作者", r"博主|账号|内容|流量|抖音|小红书"),
]
AUDIENCE_DEFAULT = "需结合账号定位判断"
SCENE_RULES = [
    ("求职决策或面试准备场景", r"(?i)面试|简历|offer"),
    ("内容生产和账号增长场景", r"账号|内容|视频|直播|选题"),
    ("个人商业化或获客场景", r"赚钱|商业|副业|客户"),
]
CONTRAST_PATTERNS = [r"不是[^。！？!?]{2,50}而是[^。！？!?]{2,60}", r"很多人[^。！？!?]{2,80}", r"真正[^。！？!?]{2,80}"]
CONTRAST_SPECIAL = "表面是方法问题，实际被归因为不愿意和更高标准的对标保持一致。"
CONTRAST_DEFAULT = "反差不明显或素材不足"
METHOD_KEYWORDS = ["第一", "第二", "方法", "步骤", "关键", "核心", "你要", "一定要"]
METHOD_SPECIAL = "用“三条大原则”先建立判断，再用“找对标的五个标准”把抽象赚钱问题拆成可执行筛选。"
METHOD_DEFAULT = "方法段需要人工复核"
PAIN_MONEY = "想赚到第一个100万，但不知道该找谁对标、如何照着更成熟的人做。"
PAIN_STANDARD = "不是没有方法，而是不愿意承认自己需要对齐更高标准。"
PROOF_COMMENTS, PROOF_NUMBERS, PROOF_DEFAULT = "评论区存在需求线索", "口播中包含数字或案例型证明", "证明素材不足"
ACTION_SAVE, ACTION_CTA, ACTION_DEFAULT = "用“视频有点长，收藏慢慢看”引导收藏。", "包含显性互动或转化动作", "未识别到明确 CTA"
# Fixed wordings of a breakdown's judgments.
MILLION = "100万|一百万"
NO_MATERIAL = "素材不足"
JUDGED_MILLION = "先用“第一个100万”给结果诱因，再把赚钱问题收束成“对标一致性”和“心理阻抗”，让用户愿意收藏长视频。"
JUDGED = ("用“", "”先制造停留，再围绕", "推进。")
JUDGED_BY_METRICS = "公开视频有互动信号，但缺少音频和画面证据，不能完整判断爆款结构。"
JUDGED_WEAKLY = "素材不足，当前只能基于标题/评论做弱判断"
STAY_RESULT, STAY_REVERSAL, STAY_DEFAULT = "结果问题足够具体，紧跟“三条”制造可获得感。", "把方法问题转成心理问题，有冒犯感和反常识停留点。", "开头能快速点名问题或结果。"
FORMULA_MILLION = "结果问题 + 三条判断 + 反常识归因 + 标准清单 + 收藏提示。"
FORMULA = ("不是泛讲主题，先抛出“", "”，再给具体场景和方法。")
VISUAL_READY, VISUAL_MISSING = "已抽帧，可进一步读图判断", "画面素材不足"
COMMENT_QUESTION = r"吗|？|\?|怎么|如何|求|请问|想问"
COMMENT_INTERACTION = (
    r"@|回复|请问|求问|想问|怎么|如何|有没有|能不能|可以吗|吗|？|\?|博主|主播|老师|求|指路|讲讲|展开说|我也|我现在|我就是|有人"
)
NOISE_LINES = ["...", "分享", "回复", "作者赞过", "加载中", "留下你的精彩评论吧"]
NOISE_PREFIXES = ["大家都在搜", "[!["]
EVIDENCE_WEIGHTS = [
    ("完整拆解报告.md", 32),
    ("report-web.json", 16),
    ("breakdown.json", 8),
    ("transcript/transcript.md", 4),
    ("frames/frames.json", 2),
    ("source/video.mp4", 1),
]

# --- HTML ---------------------------------------------------------------------------------------
FORBIDDEN_TAGS = ["style", "script", "iframe", "object", "form"]
ALLOWED_TAGS = [
    "section", "div", "p", "h2", "h3", "h4", "h5", "h6", "blockquote", "strong", "mark", "em", "s", "del", "span",
    "code", "pre", "a", "img", "figure", "figcaption", "hr", "table", "thead", "tbody", "tr", "th", "td", "sup",
    "sub",
]
SAFE_SCHEMES = ["http", "https", "mailto", "tel"]
UNSAFE_SCHEMES = ["javascript", "vbscript", "data", "file"]
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "gif", "webp"]

TYPE_LABELS = {
    "thesis": "KEY IDEA", "quote": "THE QUOTE", "chat": "CONVERSATION", "comparison": "COMPARISON",
    "formula": "THE FORMULA", "progressive-list": "KEY POINTS", "path": "THE PATH", "relation": "THE RELATION",
}
FORBIDDEN_SKIN_KEYS = ["style", "skin", "skin_id", "theme", "preset"]

# --- cards --------------------------------------------------------------------------------------
LAYER_GAP, COMPACT_GAP, STAGE_BUDGET = 24, 16, 690
ROW_DISTRIBUTIONS = {
    5: [3, 2], 6: [3, 3], 7: [4, 3], 8: [4, 4], 9: [4, 4, 1], 10: [4, 4, 2], 11: [4, 4, 3], 12: [4, 4, 4],
}
# Fixed values of the card policy: largest text weight by size; structures; sizes, fewest and most items by layout; layouts by type.
CARD_WEIGHTS = {"small": 28.0, "medium": 72.0}
LAYOUT_WEIGHTS = {"multi-item": 112.0}
CARD_STRUCTURES = [
    "short-single", "core-idea", "horizontal-relation", "parallel-row", "comparison-row", "hierarchy", "balanced-grid",
    "vertical-list", "quote", "chat",
]
CARD_LAYOUTS = {
    "single-point": (["small", "medium"], 0, 1), "narrative-path": (["medium"], 2, 4), "spoken-cause": (["medium"], 2, 4),
    "parallel": (["medium"], 2, 4), "comparison": (["medium"], 2, 2), "hierarchy": (["medium"], 2, 4), "formula": (["medium"], 2, 7),
    "multi-item": (["medium"], 5, 12), "vertical-list": (["small", "medium"], 1, 4), "quote": (["small", "medium"], 0, 0),
    "chat": (["small", "medium"], 0, 4),
}
TYPE_LAYOUTS = {
    "thesis": ["single-point"], "quote": ["quote"], "chat": ["chat"], "comparison": ["comparison"], "formula": ["formula"],
    "progressive-list": ["vertical-list"], "path": ["vertical-list"],
    "relation": ["narrative-path", "spoken-cause", "parallel", "comparison", "hierarchy", "multi-item"],
}
CONNECTED_LAYOUTS = ["narrative-path", "spoken-cause"]
CONNECTORS = ["→", "⇒"]
FIDELITY_MODE = "spoken-first"
REASON_WIDTH = 8.0

# --- stages -------------------------------------------------------------------------------------
STAGES = [
    "doctor", "preflight", "normalize", "asr_integrity", "editorial_review", "human_lock", "asr_correction",
    "semantic_review", "boundary_refine", "audit_gate", "caption_structure", "cut", "remap", "rhythm", "style_lock",
    "captions", "visual_direction", "semantic_timing", "animations", "compose", "validate", "agent_review",
]
STAGE_STATUSES = ["pending", "running", "succeeded", "failed", "blocked", "skipped"]
STAGE_ACTIONS = {
    "asr_correction": "ai_review_asr_words_then_resume",
    "editorial_review": "ai_finish_editorial_plan_then_prepare_review",
    "human_lock": "show_single_review_packet_then_lock_review",
    "semantic_review": "ai_write_semantic_cut_and_caption_plans_then_resume",
    "visual_direction": "ai_write_visual_direction_and_animation_plan_then_resume",
    "semantic_timing": "ai_write_semantic_reveal_timeline_then_resume",
    "agent_review": "spawn_fresh_ai_lens_write_ai_acceptance_then_verify",
}
