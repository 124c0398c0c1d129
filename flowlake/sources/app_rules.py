"""Seed rules of the application classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlake.plans.state import seed_if_absent

APP_RULES = "suffix string, app string, category string, confidence double, source string"

# Name suffix, application, category.
SEEDS = (
    ("weixin.qq.com", "WeChat", "chat"),
    ("wx.qq.com", "WeChat", "chat"),
    ("qq.com", "Tencent", "social"),
    ("qpic.cn", "Tencent", "social"),
    ("gtimg.com", "Tencent", "social"),
    ("tencent.com", "Tencent", "social"),
    ("meituan.com", "Meituan", "food"),
    ("meituan.net", "Meituan", "food"),
    ("dianping.com", "Meituan", "food"),
    ("taobao.com", "Taobao", "shopping"),
    ("tmall.com", "Taobao", "shopping"),
    ("alicdn.com", "Alibaba", "cdn"),
    ("alipay.com", "Alipay", "finance"),
    ("alipayobjects.com", "Alipay", "finance"),
    ("aliyuncs.com", "Alibaba", "cloud"),
    ("alibaba.com", "Alibaba", "cloud"),
    ("alidns.com", "AliDNS", "dns"),
    ("ucweb.com", "UCBrowser", "browser"),
    ("uc.cn", "UCBrowser", "browser"),
    ("douyin.com", "Douyin", "video"),
    ("bytedance.com", "ByteDance", "video"),
    ("byteimg.com", "ByteDance", "video"),
    ("snssdk.com", "ByteDance", "video"),
    ("toutiao.com", "Toutiao", "news"),
    ("bilibili.com", "Bilibili", "video"),
    ("hdslb.com", "Bilibili", "video"),
    ("baidu.com", "Baidu", "search"),
    ("bdstatic.com", "Baidu", "search"),
    ("jd.com", "JD", "shopping"),
    ("163.com", "NetEase", "media"),
    ("126.net", "NetEase", "media"),
    ("xiaomi.com", "Xiaomi", "iot"),
    ("mi.com", "Xiaomi", "iot"),
    ("miui.com", "Xiaomi", "iot"),
    ("huawei.com", "Huawei", "os"),
    ("dbankcdn.com", "Huawei", "os"),
    ("googlevideo.com", "YouTube", "video"),
    ("youtube.com", "YouTube", "video"),
    ("googleapis.com", "Google", "cloud"),
    ("gvt2.com", "Google", "os-update"),
    ("gvt1.com", "Google", "os-update"),
    ("gstatic.com", "Google", "cdn"),
    ("ggpht.com", "Google", "cdn"),
    ("google.com", "Google", "search"),
    ("apple.com", "Apple", "os"),
    ("icloud.com", "Apple", "os"),
    ("mzstatic.com", "Apple", "os"),
    ("cdn-apple.com", "Apple", "os"),
    ("windowsupdate.com", "Microsoft", "os-update"),
    ("microsoft.com", "Microsoft", "os"),
    ("live.com", "Microsoft", "os"),
    ("msftncsi.com", "Microsoft", "os"),
    ("amazonaws.com", "AWS", "cloud"),
    ("cloudflare.com", "Cloudflare", "cdn"),
    ("akamaized.net", "Akamai", "cdn"),
    ("akamai.net", "Akamai", "cdn"),
    ("facebook.com", "Facebook", "social"),
    ("fbcdn.net", "Facebook", "social"),
    ("github.com", "GitHub", "dev"),
    ("githubusercontent.com", "GitHub", "dev"),
)


def seed_app_rules(spark: SparkSession, rules: DataFrame | None = None) -> DataFrame:
    """The rules plus the seeds whose suffix they lack."""
    seeds = spark.createDataFrame([(*r, 0.9, "seed") for r in SEEDS], APP_RULES)
    return seed_if_absent(rules if rules is not None else spark.createDataFrame([], APP_RULES), seeds, "suffix")
