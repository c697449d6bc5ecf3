"""Lists, weights and patterns that must equal the published service's for
equal results. They are data, stated as they are, and every operator takes them as
parameters."""

# Web trust: host weights, first listed match wins.
TRUSTED_DOMAINS = {
    "thuvienphapluat.vn": 1.0,
    "vbpl.vn": 1.0,
    "moj.gov.vn": 1.0,
    "phapdien.moj.gov.vn": 1.0,
    "quochoi.vn": 0.95,
    "chinhphu.vn": 0.9,
    "toaan.gov.vn": 0.9,
    "luatvietnam.vn": 0.85,
    "lawnet.vn": 0.85,
}
UNTRUSTED_PATTERNS = [
    "blogspot", "wordpress", "facebook", "tiktok", "youtube", "forum", "wiki", "123doc",
    "tailieu", "slideshare", "scribd",
]
LEGAL_KEYWORDS = [
    "điều", "khoản", "nghị định", "thông tư", "luật", "bộ luật", "quyết định", "quy định",
    "xử phạt", "điều khoản", "văn bản", "pháp luật", "hành chính",
]
RECENT_KEYWORDS = [
    "2025", "2024", "mới nhất", "hiện tại", "hiện nay", "gần đây", "vừa ban hành",
    "mới ban hành", "năm nay",
]
REALTIME_KEYWORDS = [
    "hôm nay", "hiện tại", "hiện nay", "bây giờ", "mới nhất", "tháng này", "năm nay", "đang",
    "gần đây", "giá", "tỷ giá", "lãi suất", "chỉ số", "thống kê", "2025", "2024",
]

# Turn gate.
OFFENSIVE_TERMS = ["dm", "đm", "ngu", "óc chó", "fuck", "shit"]
JAILBREAK_PHRASES = [
    "ignore all previous instructions", "disable safety", "run shell command",
    "execute python", "prompt injection",
]
VOWELS = ("aeiouyàáạảãăắằẳẵặâấầẩẫậèéẹẻẽêếềểễệìíịỉĩ"
          "òóọỏõôốồổỗộơớờởỡợùúụủũưứừửữựỳýỵỷỹ")
LETTER_CLASS = "A-Za-zÀ-ỹ"
EMOJI_RANGES = [(0x1F300, 0x1F6FF), (0x1F900, 0x1FAFF), (0x2600, 0x26FF), (0x2700, 0x27BF)]
QUICK_KEYS = [
    "xin chào", "chào bạn", "hello", "hi", "okay", "ok", "oke", "bạn là ai",
    "bạn có thể làm gì", "bạn có thể giúp gì", "bạn giúp được gì", "giới thiệu", "bắt đầu",
    "bắt đầu như thế nào", "cảm ơn", "tạm biệt",
]
META_DEFAULT_KEY = "bạn có thể làm gì"
LEGAL_QUERY_PATTERN = (
    r"\b(luật\s+gì|điều\s+\d+|nghị\s+định|thông\s+tư|xử\s+phạt|hình\s+sự|dân\s+sự|"
    r"hành\s+chính|thủ\s+tục|khi\s+nào|bao\s+nhiêu|có\s+được|bị\s+phạt|quy\s+định)\b")
META_PATTERN = (
    r"(bạn\s+(có thể|là ai|giúp)|mày\s+là ai|làm\s+(gì|được gì)|giúp\s+(gì|được gì|tôi)|"
    r"chào\b|xin\s+chào|hello\b|\bhi\b|giới\s+thiệu|bắt\s+đầu|cảm\s+ơn|tạm\s+biệt)")
SENTIMENT_LABELS = [
    "neutral_info", "satisfied", "urgent", "sad", "dissatisfied", "angry", "grateful_polite",
    "hostile_abusive",
]
TONE_LABELS = [
    "neutral_info", "satisfied", "confused", "anxious", "urgent", "sad", "dissatisfied",
    "angry", "grateful_polite", "hostile_abusive",
]
NEGATIVE_LABELS = ["sad", "dissatisfied", "angry", "hostile_abusive"]

# Memory.
MEMORY_TYPES = ["core", "episodic", "semantic", "procedural"]
MEMORY_HEADER = "[Bộ nhớ về người dùng — dùng để cá nhân hóa câu trả lời]"
REPLACEMENT_PATTERN = (
    r"(chuyển\s+sang|chuyển\s+đến|chuyển\s+vào|chuyển\s+thành|thành|trở thành|giờ\s+là|"
    r"giờ\s+làm|hiện\s+(tại|nay)|đổi\s+(sang|thành|qua)|mới\s+(là|đang|chuyển|làm|học|sống|ở))")
SENSITIVE_PATTERNS = [
    r"\b\d{9,12}\b",
    r"\b\d{4,}[\s\-]?\d{4,}[\s\-]?\d{4,}\b",
    r"\b\d{16,19}\b",
]

# Analyzer.
STOPWORDS = ["chứ", "đó", "này", "là", "vậy", "cứ", "gì"]
SYNONYM_GROUPS = [
    "luật, pháp luật, quy định, điều lệ, quy tắc, luật pháp",
    "hợp pháp, hợp lệ, đúng luật, chính đáng, chính thống, đúng quy định",
    "trái phép, phạm pháp, phi pháp, trái luật",
    "pháp lý, tư pháp, pháp chế, pháp quyền, pháp định",
    "điều luật, khoản luật, mục luật, điều khoản",
    "thẩm quyền, quyền hạn, quyền lực",
    "vi phạm, xâm phạm, trái luật",
    "hình phạt, xử phạt, án phạt, chế tài",
    "tội phạm, tội đồ, kẻ vi phạm, kẻ phạm pháp",
    "nghĩa vụ, bổn phận, phận sự",
    "bằng chứng, chứng cứ, vật chứng",
    "phán quyết, quyết định, bản án",
    "tòa án, pháp đình, phiên tòa",
    "luật sư, luật gia",
    "tranh chấp, xung đột, mâu thuẫn",
    "hòa giải, thương lượng, đàm phán, giải hòa",
    "kháng cáo, khiếu nại, kháng nghị",
    "quyền lợi, lợi ích, phúc lợi",
    "hợp đồng, giao kèo, cam kết",
    "chứng thực, công chứng, xác minh",
    "truy tố, buộc tội, cáo buộc",
    "công lý, lẽ phải, chính nghĩa",
    "thủ tục, quy trình, cách thức",
    "quyền sở hữu, quyền sử dụng",
    "thời hiệu, thời hạn, kỳ hạn",
    "bắt giữ, giam giữ, giam cầm",
    "tự do, độc lập, tự trị",
    "xét xử, phán xét, xử án",
    "hình thức, biện pháp, phương án",
    "án lệ, tiền lệ",
    "khởi kiện, tố cáo, kiện tụng",
    "thi hành, áp dụng, chấp hành",
    "phạm nhân, tù nhân, bị cáo",
    "lệnh bắt, lệnh giam",
    "tạm giam, giam lỏng",
    "giám định, kiểm định, thẩm định",
    "chế tài, xử phạt",
    "quy định, điều khoản, nội quy",
    "hành vi, hành động, cử chỉ",
    "truy cứu, điều tra",
    "biên bản, báo cáo, hồ sơ",
    "khiếu nại, tố cáo",
    "chứng từ, tài liệu",
    "bảo vệ, giữ gìn",
]
FIELD_BOOSTS = {"tenchude": 1.0, "tendemuc": 1.5, "tenchuong": 2.0, "tendieu": 10.0,
                "noidung": 9.0}

# Graph.
CITATION_PATTERN = r"\b(\d+\.\d+\.[A-ZĐ]+\.\d+(?:\.\d+)*)\b"
RELATED = "LIEN_QUAN"
CITES = "THAM_CHIEU"

# Texts with a fixed form.
TRUNCATED_MARK = "\n… [đã rút gọn]"
CORPUS_LABEL = "[Pháp Điển]"
WEB_LABEL = "[Web]"
TRUST_LABELS = {"high": "[Web]", "medium": "[Web - tham khảo]",
                "low": "[Web - không tin cậy]"}
SOURCES_HEADER = "\n\n---\n**Nguồn tham khảo từ web:**"
DEFAULT_TITLE = "Cuộc trò chuyện"
EMPTY_TITLE = "Cuộc trò chuyện mới"
CHAPTER_PREFIX = "Chương "
ROMAN = {"I": 10, "V": 50, "X": 100, "L": 500, "C": 1000, "D": 5000, "M": 10000}
ROMAN_LETTERS = "ABCDEFGHI"
