"""Values that results depend on."""

from __future__ import annotations

#: Query parameters that don't identify a page.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_cid", "utm_reader", "utm_viz_id", "fbclid", "gclid",
    "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "referrer", "spm", "from", "source", "cmpid",
]

#: Top-level domains whose hosts are dropped without a rule table.
JUNK_TLDS = [
    ".top", ".xyz", ".icu", ".info", ".club", ".online", ".site", ".shop", ".fun", ".work", ".live", ".buzz", ".loan", ".gdn", ".vip", ".click",
    ".link", ".zip", ".review", ".racing", ".accountant", ".stream", ".download", ".win", ".bid", ".party", ".trade", ".date", ".faith", ".webcam",
    ".email", ".monster", ".science", ".rest", ".cam", ".men", ".mom",
]

#: Link shorteners.
SHORTENERS = ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "shorturl.at", "cutt.ly", "is.gd", "buff.ly", "ow.ly", "tiny.cc", "rebrand.ly", "s.id", "tny.im", "rb.gy", "0rz.tw", "shortest.link", "lnkd.in"]

#: Hosts ranked lower by default.
LOWERED = ["baijiahao.baidu.com", "blog.csdn.net", "zhihu.com", "mp.weixin.qq.com", "toutiao.com"]

#: First-party documentation hosts.
AUTHORITY_HOSTS = [
    "developers.weixin.qq.com", "pay.weixin.qq.com", "kf.qq.com", "mp.weixin.qq.com", "nodejs.org", "vuejs.org", "react.dev", "angular.io",
    "svelte.dev", "python.org", "rust-lang.org", "go.dev", "typescriptlang.org", "php.net", "ruby-lang.org", "redis.io", "nginx.org", "nginx.com",
    "docker.com", "kubernetes.io", "postgresql.org", "mysql.com", "elastic.co", "mongodb.com", "apache.org", "git-scm.com",
    "developer.mozilla.org", "w3.org", "ietf.org", "kernel.org", "gnu.org", "opendocs.alipay.com", "alipay.com", "amap.com", "lbs.amap.com",
    "12306.cn", "gov.cn", "sf-express.com",
]

#: Tutorial aggregators.
TUTORIAL_HOSTS = ["runoob.com", "juejin.cn", "csdn.net", "cnblogs.com", "geeksforgeeks.org", "w3schools.com", "segmentfault.com", "jianshu.com", "fanruan.com", "developer.aliyun.com", "cloud.tencent.com", "cn.aliyun.com"]

#: Hosts that copy official documentation.
MIRROR_HOSTS = ["nodejs.cn", "vueframework.com", "reactjs.org.cn", "reactjs.bootcss.com", "bootcss.com", "python3.com", "redis.cn", "dockerinfo.com"]

#: Product names that no host spells, in order of precedence.
OFFICIAL_ALIASES = [("golang", "go.dev"), ("k8s", "kubernetes.io"), ("微信支付", "pay.weixin.qq.com"), ("微信小程序", "developers.weixin.qq.com"), ("小程序", "developers.weixin.qq.com"), ("公众号", "mp.weixin.qq.com")]

#: Host labels without product meaning.
LABEL_STOP = [
    "www", "docs", "doc", "dev", "developer", "developers", "learn", "api", "reference", "com", "org", "net", "io", "cn", "co", "gov", "edu",
    "ac", "pay", "mp", "kf", "lbs", "open", "portal", "support", "help",
]

#: Patterns.
DOC_PATH = r"(?i)/doc|/docs|/documentation|/api/|/reference|/manual|/guide|/spec|/learn\b"
DOC_HOST = r"(?i)(^|\.)(docs|dev|developer|developers|learn|api|reference)\."
ECHO_WORDS = "图片|视频|大全|相关搜索|最新|推荐|下载|专题|资讯|排行|问答|论坛|贴吧|在线观看|免费在线|高清|完整版|免费下载|聚合|导航|百科"
AGGREGATOR_HOSTS = r"image\.baidu\.com|lightapp\.baidu\.com"
HAN_RUN = "[一-鿿㐀-䶿豈-﫿]"
WEIXIN_QUERY = "微信|小程序|公众号|视频号|朋友圈|微信支付"

#: Weights of the engines in the older score; any other has 0.8.
ENGINE_WEIGHTS = {
    "intlBing": 1.0, "sogou": 0.95, "sogouWeixin": 0.95, "ddgs": 0.95, "cnBing": 0.9, "bing": 0.9, "baiduMobile": 0.9, "baidu": 0.85, "so360": 0.8,
    "tavily": 1.0, "bocha": 1.0, "zhipu": 1.0,
}
DEFAULT_ENGINE_WEIGHT = 0.8

#: White space as browsers see it.
SPACE = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same for DuckDB's regular expressions.
SPACE_RE2 = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
