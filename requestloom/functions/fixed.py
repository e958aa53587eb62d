"""Fixed values.

Everything in this file is a value that results depend on (limits, constants
of the two request formats, message texts, the model catalog).  They are stated
as plain text, in natural order, and must not be changed.
"""

# Object routing: file-name endings per modality.
TEXT_EXTENSIONS = ("txt",)
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm", "flv")

EXTENSIONS = {
    "text": TEXT_EXTENSIONS,
    "image": IMAGE_EXTENSIONS,
    "video": VIDEO_EXTENSIONS,
}
MODALITIES = ("text", "image", "video")

# Payload limits, in characters of base64 text.
IMAGE_MAX_BASE64 = 20 * 1024 * 1024
VIDEO_MAX_BASE64 = 25 * 1024 * 1024
MAX_BASE64 = {"image": IMAGE_MAX_BASE64, "video": VIDEO_MAX_BASE64}

# Raw video size above which an advisory is reported.
VIDEO_ADVISORY_BYTES = 20 * 1024 * 1024

# Request constants.
CLAUDE_VERSION = "bedrock-2023-05-31"
NOVA_SCHEMA_VERSION = "messages-v1"
TEXT_SEPARATOR = "\n\n原始文本:\n"
TEXT_MAX_TOKENS = 2048
TEXT_TEMPERATURE = 0.1
MEDIA_MAX_TOKENS = 300
DEFAULT_VIDEO_SYSTEM = "你是一个专业的视频分析助手。"
DEFAULT_VIDEO_FORMAT = "mp4"
DEFAULT_IMAGE_FORMAT = "jpeg"

# Result texts.
UNKNOWN_STOP = "unknown"
ERROR_STOP = "error"
MISSING_ERROR_CODE = "N/A"
MISSING_ERROR_MESSAGE = "未知错误"
FAILED_PREFIX = "[处理失败] 错误码"
PARSE_WARNING = "结果文件已找到，但预览数据解析失败。请直接访问S3文件获取完整结果。"
NO_RESULT_FILE = "未找到结果文件"

# Preview sizes.
PREVIEW_LINES = {"text": 3, "image": 3, "video": 1}
PREVIEW_CHARS = 200
REQUEST_PREVIEW_CHARS = 500
FALLBACK_BYTES = 51200
FALLBACK_LINES = 5
RECENT_JOBS = 10

# Whitespace removed around a line (what a Unicode-aware strip removes).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Messages about missing input, after "在 {bucket}/{prefix} ".
NO_OBJECTS = "中未找到任何文件"
NO_TEXT = "中未找到任何.txt文件（共{}个文件）"
NO_IMAGES = "中未找到任何图片文件"
NO_VIDEOS = "中未找到任何视频文件"

# Reject reasons.
OVERSIZED = "Base64编码后大小 {} 字符超过限制 {}"
UNREADABLE = "unreadable content"

# Job status groups.
TERMINAL_STATUSES = ("Completed", "Failed", "Stopped")
RUNNING_STATUSES = ("Submitted", "InProgress")

# Config rules.
ROLE_PREFIX = "arn:aws:iam::"
BUCKET_PATTERN = r"(?d)^[a-z0-9][a-z0-9.\-]*[a-z0-9]$"
BUCKET_MIN, BUCKET_MAX = 3, 63
ROLE_OK = "✓ Role ARN格式正确"
ROLE_BAD = "✗ Role ARN格式不正确: "
INPUT_BUCKET_OK = "✓ 输入bucket名称格式有效: "
INPUT_BUCKET_BAD = "✗ 输入bucket名称格式无效: "
OUTPUT_BUCKET_OK = "✓ 输出bucket名称格式有效: "
OUTPUT_BUCKET_BAD = "✗ 输出bucket名称格式无效: "
MODEL_OK = "✓ 模型ID格式有效: "
MODEL_BAD = "✗ 模型ID格式无效: "
CONFIG_INCOMPLETE = "请填写所有必填配置项"
CONFIG_PASSED = "配置验证通过，可以开始批处理！"
CONFIG_FAILED = "请修复上述问题后再提交任务"
CONFIG_WARNINGS = (
    "⚠ 实际的S3和Bedrock权限将在任务提交时由AWS服务验证",
    "⚠ 如果权限不足，任务会在执行时失败并提供详细错误信息",
    "⚠ 建议先用少量文件测试权限配置",
)

# Submission rules.
MISSING_REQUIRED = "请填写所有必填字段"
INVALID_MODEL = "无效的模型选择"
MISSING_URI = {
    "text": "请输入JSONL文件的S3 URI",
    "image": "JSONL模式需要填写JSONL文件S3 URI",
    "video": "JSONL模式需要填写JSONL文件S3 URI",
}
MISSING_INPUT = {
    "text": "原始文件模式需要填写输入Bucket和Prompt",
    "image": "原始图片模式需要填写输入Bucket和User Prompt",
    "video": "原始视频模式需要填写输入Bucket和User Prompt",
}
CLAUDE_FILE_FOR_NOVA = "JSONL文件格式不匹配：文件是为Claude模型生成的（包含max_tokens），但您选择了Nova模型。请使用匹配的模型或重新生成JSONL文件。"
NOVA_FILE_FOR_CLAUDE = "JSONL文件格式不匹配：文件是为Nova模型生成的（包含inferenceConfig），但您选择了Claude模型。请使用匹配的模型或重新生成JSONL文件。"

# Model catalog: (modality, model name, model id).
MODEL_CATALOG = (
    ("text", "Claude 3 Haiku", "us.anthropic.claude-3-haiku-20240307-v1:0"),
    ("text", "Claude 3 Sonnet", "us.anthropic.claude-3-sonnet-20240229-v1:0"),
    ("text", "Claude 3 Opus", "us.anthropic.claude-3-opus-20240229-v1:0"),
    ("text", "Claude 3.5 Haiku", "us.anthropic.claude-3-5-haiku-20241022-v1:0"),
    ("text", "Claude 3.5 Sonnet", "us.anthropic.claude-3-5-sonnet-20240620-v1:0"),
    ("text", "Claude 3.5 Sonnet v2", "us.anthropic.claude-3-5-sonnet-20241022-v2:0"),
    ("text", "Claude 3.7 Sonnet", "us.anthropic.claude-3-7-sonnet-20250219-v1:0"),
    ("text", "Claude Haiku 4.5", "us.anthropic.claude-haiku-4-5-20251001-v1:0"),
    ("text", "Claude Sonnet 4", "us.anthropic.claude-sonnet-4-20250514-v1:0"),
    ("text", "Claude Sonnet 4.5", "us.anthropic.claude-sonnet-4-5-20250929-v1:0"),
    ("text", "Nova Micro", "us.amazon.nova-micro-v1:0"),
    ("text", "Nova Lite", "us.amazon.nova-lite-v1:0"),
    ("text", "Nova Pro", "us.amazon.nova-pro-v1:0"),
    ("text", "Nova Premier", "us.amazon.nova-premier-v1:0"),
    ("image", "Claude 3 Haiku", "us.anthropic.claude-3-haiku-20240307-v1:0"),
    ("image", "Claude 3 Sonnet", "us.anthropic.claude-3-sonnet-20240229-v1:0"),
    ("image", "Claude 3 Opus", "us.anthropic.claude-3-opus-20240229-v1:0"),
    ("image", "Claude 3.5 Haiku", "us.anthropic.claude-3-5-haiku-20241022-v1:0"),
    ("image", "Claude 3.5 Sonnet", "us.anthropic.claude-3-5-sonnet-20240620-v1:0"),
    ("image", "Claude 3.5 Sonnet v2", "us.anthropic.claude-3-5-sonnet-20241022-v2:0"),
    ("image", "Claude 3.7 Sonnet", "us.anthropic.claude-3-7-sonnet-20250219-v1:0"),
    ("image", "Claude Haiku 4.5", "us.anthropic.claude-haiku-4-5-20251001-v1:0"),
    ("image", "Claude Sonnet 4", "us.anthropic.claude-sonnet-4-20250514-v1:0"),
    ("image", "Claude Sonnet 4.5", "us.anthropic.claude-sonnet-4-5-20250929-v1:0"),
    ("image", "Nova Lite (Image)", "us.amazon.nova-lite-v1:0"),
    ("image", "Nova Pro (Image)", "us.amazon.nova-pro-v1:0"),
    ("image", "Nova Premier (Image)", "us.amazon.nova-premier-v1:0"),
    ("video", "Nova Pro (Video)", "us.amazon.nova-pro-v1:0"),
    ("video", "Nova Premier (Video)", "us.amazon.nova-premier-v1:0"),
)
