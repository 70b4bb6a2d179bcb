"""Rules for Vietnamese course questions: pass them where ``routing`` and ``evaluate`` take word lists."""

# Phrases that results depend on.

OUT_OF_SCOPE = ("thời tiết", "tỷ giá", "giá bitcoin", "bóng đá", "nấu ăn", "lập trình", "đạo hàm", "adn")

QUESTION_RULES = (
    ("mcq", r"(^|[^\p{L}\p{N}_])[abcd]\s*[.)]", ("đáp án",)),
    ("comparison", None, ("so sánh", "khác nhau", "giống nhau")),
    ("exact_quote", None, ("trích nguyên văn", "nguyên văn", "trích dẫn")),
    ("definition", None, ("là gì", "khái niệm", "định nghĩa")),
    ("essay", None, ("phân tích", "trình bày", "chứng minh")),
)

SUBJECT_PHRASES = {
    "MLN111": ("triết học", "vật chất", "ý thức", "phép biện chứng", "lý luận nhận thức", "vai trò của thực tiễn"),
    "MLN122": ("kinh tế chính trị", "giá trị thặng dư", "hàng hóa", "kinh tế thị trường", "tư bản bất biến", "tư bản khả biến", "quan hệ lợi ích"),
    "MLN131": ("chủ nghĩa xã hội khoa học", "sứ mệnh lịch sử của giai cấp công nhân", "cơ cấu xã hội - giai cấp", "dân tộc tộc người", "vấn đề gia đình"),
    "HCM202": ("tư tưởng hồ chí minh", "quan điểm của hồ chí minh", "hồ chí minh quan niệm", "đại đoàn kết dân tộc", "đạo đức cách mạng"),
    "VNR202": ("lịch sử đảng", "đảng cộng sản việt nam", "đại hội đại biểu toàn quốc", "đường lối đổi mới", "cách mạng tháng tám", "ba giai đoạn"),
}

REFERENCES = (
    "chúng", "chúng nó", "hai khái niệm", "hai yếu tố", "hai cái", "điều đó", "ý đó", "cái đó", "định nghĩa đó", "khái niệm đó", "quan điểm đó", "vấn đề đó",
    "nó ", "họ ", "ông ấy", "tại sao vậy", "vì sao vậy", "giải thích thêm", "nói rõ hơn", "so sánh thêm",
)
SHORT_QUESTION = r"^(tại sao|vì sao|như thế nào|cụ thể là gì)[?.!]*$"

TOOL_RULES = (
    ("source_page", ("trang bao nhiêu", "trang nào", "nguồn pdf")),
    ("citation", ("trích dẫn", "dẫn nguồn", "citation")),
    ("graph", ("mối quan hệ", "quan hệ giữa", "ảnh hưởng", "dẫn đến", "multi-hop")),
)
ACROSS = ("liên môn", "cả năm môn", "giữa các môn")

STOPWORDS = ("ai", "bao", "các", "có", "của", "đã", "được", "gì", "khi", "là", "nào", "những", "như", "theo", "thế", "trong", "và", "về", "vì")

COMPARISON = r"^(?i:so sánh) (.{8,}?) (?:và|với) (.{8,})$"

PORTFOLIO = (("direct", 13), ("explanation", 10), ("comparison_relationship", 8), ("multi_chunk", 7), ("synthesis", 5), ("multi_hop_cross_chapter", 3), ("negative", 4))
